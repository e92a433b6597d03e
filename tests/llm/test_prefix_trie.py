"""The prefix trie against prefixes counted one by one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanlake.llm import prefix_trie
from cleanlake.llm.shared import numbered, written
from llm_data import words

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(np.fmod(c, 20))
        out[c] = convs.get(first, [])[:h] + own[h:]
    return out


def plain_nodes(seqs):
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, own in members.items():
        n = len(words(key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(own) - 1) * n
    return sorted(
        (
            min(own), len(key), min(members[key[:-1]]) if key else -1, len(own), children[key], leaves[key], saved[key],
            hashlib.sha256(",".join(str(c) for c in sorted(own) if len(seqs[c]) == len(key)).encode()).hexdigest(),
        )
        for key, own in members.items()
    )


def found_nodes(frame):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, frame.select(*COLUMNS).collect()))


def trie_of(spark, convs, **bounds):
    rows = [(c, i, r, t) for c, own in convs.items() for i, (r, t) in enumerate(own)]
    rows = spark.createDataFrame(rows, SCHEMA)
    turns = prefix_trie.turn_rows(rows).withColumnRenamed("i", "place")
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    return prefix_trie.prefix_nodes(ids, written(turns, "turns"), **bounds)


def random_convs(seed, n, length, texts):
    chance = random.Random(seed)
    return {
        c: [(chance.choice(["user", "assistant"]), chance.choice(texts)) for _ in range(chance.randint(0, length))]
        for c in range(3, 3 + n)
    }


@pytest.mark.parametrize("bounds", [{}, {"shard": 1}, {"segment": 2, "shard": 5}, {"segment": 1, "shard": 3}])
def test_segments_and_shards_make_no_difference(spark, bounds):
    """Many shared beginnings, cut at every place there is."""
    convs = random_convs(1, 70, 5, ["", "one", "two words"])
    assert found_nodes(trie_of(spark, convs, **bounds)) == plain_nodes(convs)


def test_many_copies_and_one_long_conversation(spark):
    """A group of copies is one sequence; a long conversation is cut."""
    convs = {c: [("user", "hello there"), ("assistant", "same")] for c in range(500)}
    convs |= {1000 + c: [("user", "hello there"), ("assistant", f"answer {c}")] for c in range(100)}
    convs[2000] = [("user", f"turn {i}") for i in range(45)]
    convs[2001] = convs[2000][:40] + [("user", "another end")]
    convs[2002] = []
    bounds = {"segment": 10, "shard": 50}
    assert found_nodes(trie_of(spark, convs, **bounds)) == plain_nodes(convs)


def test_rows_of_all_kinds(spark, monkeypatch):
    """Null and repeated turns, null roles, texts and ids, negative ids, extra columns; empty tables."""
    monkeypatch.setattr(prefix_trie, "JOINED", 3)
    chance = random.Random(4)
    rows = [
        (
            chance.choice([None, -21, -20, *range(0, 45)]), chance.choice([None, 0, 0, 1, 2, 5]),
            chance.choice([None, "", "user"]), chance.choice([None, "", "a b", "a\x0bb", "x" * 3000]),
        )
        for _ in range(220)
    ]
    rows += rows[:30]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("conv", "i", "k1", "w", "z1", "n", "place", "level", "first"):
        frame = frame.withColumn(name, F.lit("x"))
    turns = prefix_trie.turn_rows(frame)
    assert found_nodes(prefix_trie.prefix_nodes(*prefix_trie.with_shared_beginnings(turns))) == plain_nodes(
        rebuilt(ordered(rows))
    )
    assert found_nodes(prefix_trie.conversation_trie(frame)) == plain_nodes(ordered(rows))
    assert prefix_trie.conversation_trie(frame.limit(0)).count() == 0
    assert prefix_trie.prefix_nodes(*prefix_trie.with_shared_beginnings(prefix_trie.turn_rows(frame.limit(0)))).count() == 0


def test_query_equals_plain_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = prefix_trie.op11_prefix_trie(spark, folder)
    assert found.columns == COLUMNS
    want = plain_nodes(rebuilt(ordered(rows)))
    assert found_nodes(found) == want
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    own = db.execute(f"select {', '.join(COLUMNS)} from ({prefix_trie.SQL})").fetchall()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in own) == want


def test_numbers_across_tasks(spark):
    """One value holds most rows, over all tasks, with ties; the numbers are those of one sort."""
    chance = random.Random(9)
    rows = [(7 if k % 5 else chance.randrange(20), chance.choice([None, 1, 2, 3]), f"t{k % 37}") for k in range(4_000)]
    frame = spark.createDataFrame(rows, "g long, turn long, text string").repartition(6)
    out = numbered(frame, "g", [F.col("turn").asc_nulls_first(), F.col("text")], [F.col("turn"), F.col("text")])
    found = defaultdict(list)
    for r in out.collect():
        found[r["g"]].append((r["i"], r["turn"], r["text"]))
    for g, own in found.items():
        want = sorted(((t is not None, t or 0, x) for h, t, x in rows if h == g))
        assert [i for i, *_ in sorted(own, key=lambda r: r[0])] == list(range(len(want)))
        assert [(t is not None, t or 0, x) for _, t, x in sorted(own, key=lambda r: r[0])] == want


def test_double_array(monkeypatch):
    """Every edge is found and no other, however crowded the array is."""
    chance = np.random.default_rng(3)
    for tries in (1, 32):
        monkeypatch.setattr(prefix_trie, "TRIES", tries)
        seqs = sorted({tuple(chance.integers(1, 9, chance.integers(1, 6)).tolist()) for _ in range(400)})
        size = np.array([len(s) for s in seqs])
        ids = np.array([i for s in seqs for i in s], np.int64)
        trie = prefix_trie.packed(ids, np.cumsum(size) - size, size)
        known = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
        assert int((trie.check >= 0).sum()) == len(known)

        def walk(seq):
            at = np.array([0])
            for label in seq:
                at = trie.step(at, np.array([label]))
                if at[0] < 0:
                    return False
            return True

        assert all(walk(s) for s in known)
        others = {tuple(chance.integers(1, 12, chance.integers(1, 6)).tolist()) for _ in range(500)} - known
        assert not any(walk(s) for s in others)
