"""The prefix trie of conversations, by double arrays over ranges of sorted sequences.

A conversation is its sequence of turns, each a pair of 64-bit hashes of its place, role and text; the
exclusive or of these names a prefix. Equal sequences are counted once. Sorted, they are dealt
by ranges, so a shard holds neighbours that share prefixes, and no prefix is too frequent for it:
a frequent one lies in several shards. Each shard numbers its turns densely, packs BASE and CHECK arrays and
walks all its sequences through them; sums go up along CHECK. What two shards share is a path of
upper nodes: the first that has a node owns it, and the sums of all are added globally.

Sequences longer than a segment are cut. Segments of the deepest level come first; what is below
a segment's last node is then known to the level above. So no row and no task holds a whole
conversation of any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanlake.llm.shared import BLANKS, forget, numbered, table, written

#: Turns of a segment; turns of a shard, after which the next one begins.
SEGMENT, SHARD = 1_000, 200_000
#: Places that are tried for the children of one node before they go behind all others.
TRIES = 32
#: Characters of conversation ids that are joined in one row.
JOINED = 1_000_000


class DoubleArray:
    """A static trie: the child of ``node`` by ``label`` is ``base[node] + label`` if ``check`` there is
    ``node``. Nodes are slots, the root is slot 0.

    Made from edges: ``parent`` and ``label`` of nodes 1, 2, ..., parents before children.
    """

    def __init__(self, parent: np.ndarray, label: np.ndarray):
        nodes = len(parent) + 1
        order = np.lexsort((label, parent))
        counts = np.bincount(parent, minlength=nodes)
        first = np.cumsum(counts) - counts
        slot = np.zeros(nodes, np.int64)
        base = np.zeros(nodes, np.int64)
        used = np.zeros(2 * nodes + int(label.max(initial=0)) + 2, bool)
        used[0] = True
        end = 1  # all slots from here on are free
        several = np.flatnonzero(counts > 1)
        # Nodes with most children first: the others fit between theirs.
        for node in several[np.argsort(-counts[several], kind="stable")].tolist():
            own = order[first[node] : first[node] + counts[node]]
            labels = label[own]
            steps = labels - labels[0]
            while end + steps[-1] >= len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            at = end
            if steps[-1] < end:
                free = np.flatnonzero(~used[:end])[:TRIES]
                free = free[free + steps[-1] < len(used)]
                fits = free[~used[free[:, None] + steps].any(axis=1)] if len(free) else free
                at = int(fits[0]) if len(fits) else end
            base[node] = at - labels[0]
            slot[own + 1] = at + steps
            used[at + steps] = True
            end = max(end, at + int(steps[-1]) + 1)
        one = np.flatnonzero(counts == 1)
        own = order[first[one]]
        while True:
            free = np.flatnonzero(~used)[: len(one)]
            if len(free) == len(one):
                break
            used = np.concatenate([used, np.zeros(len(used), bool)])
        base[one] = free - label[own]
        slot[own + 1] = free
        size = int(slot.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]

    def step(self, nodes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The child of each node by its label, -1 where there is none."""
        to = self.base[nodes] + labels
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == nodes), to, -1)


def dense(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct pairs."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate([[False], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def common(a: list, b: list) -> int:
    """How many members two sequences have in common at their beginning."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def packed(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> DoubleArray:
    """The trie of sorted distinct sequences, which lie end to end in ``ids``."""
    number = len(size)
    shared = np.zeros(number, np.int64)
    alive = np.arange(1, number)
    depth = 0
    while len(alive):
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        alive = alive[ids[begin[alive] + depth] == ids[begin[alive - 1] + depth]]
        shared[alive] += 1
        depth += 1
    node = np.zeros(len(ids), np.int64)
    parents, labels, made = [], [], 1
    for depth in range(int(size.max())):
        here = np.flatnonzero(size > depth)
        new = shared[here] <= depth
        node[begin[here] + depth] = made - 1 + np.cumsum(new)
        at = begin[here[new]] + depth
        parents.append(node[at - 1] if depth else np.zeros(len(at), np.int64))
        labels.append(ids[at])
        made += len(at)
    return DoubleArray(np.concatenate(parents), np.concatenate(labels))


_COUNTS = ("n", "children", "leaves", "saved", "n_end")
_NODE = (
    "kind int, depth long, z1 long, z2 long, p1 long, p2 long, conv long, n long, children long, leaves long, "
    "saved long, n_end long, end_conv long, above long"
)
#: Kinds of rows: a node that lies in one shard, part of one that may lie in several, and what is
#: below the first node of a segment.
INNER, UPPER, BELOW = 0, 1, 2
_SEQUENCE = ("n", "conv", "n_end", "end_conv", "t_children", "t_leaves", "t_saved")


def shard_nodes(shard: dict, level: int, segment: int) -> pa.RecordBatch:
    """The nodes of one shard.

    ``z1``, ``z2``, ``w``: the members of all sequences, the first of each being the prefix that its
    segment goes on from; ``size``; per sequence the members of _SEQUENCE; ``before``: how many members
    the sequence before the first one shares with it; ``extended``: whether the one after the last one
    goes on from it.
    """
    z1, z2, w, size = (np.asarray(shard[c], np.int64) for c in ("z1", "z2", "w", "size"))
    of = {c: np.asarray(shard[c], np.int64) for c in _SEQUENCE}
    end = np.cumsum(size)
    begin = end - size
    ids = dense(z1, z2) + 1
    trie = packed(ids, begin, size)
    slot = np.empty(len(ids), np.int64)
    now = np.zeros(len(size), np.int64)
    for depth in range(int(size.max())):
        here = np.flatnonzero(size > depth)
        now[here] = slot[begin[here] + depth] = trie.step(now[here], ids[begin[here] + depth])
    if slot.min() < 1:
        raise RuntimeError("a sequence is not in its trie")

    slots = len(trie.check)
    zeros = lambda: np.zeros(slots, np.int64)
    sequence = np.repeat(np.arange(len(size)), size)
    n, conv, end_conv = zeros(), np.full(slots, np.iinfo(np.int64).max), np.full(slots, -1)
    np.add.at(n, slot, of["n"][sequence])
    np.minimum.at(conv, slot, of["conv"][sequence])
    words, depths, keys = zeros(), zeros(), [zeros(), zeros()]
    words[slot] = w
    depths[slot] = np.arange(len(ids)) - begin[sequence]
    for key, z in zip(keys, (z1, z2)):
        upto = np.bitwise_xor.accumulate(z)
        key[slot] = upto ^ np.concatenate([[0], upto])[begin][sequence]
    owned, upper, last = np.ones(slots, bool), np.zeros(slots, bool), slot[end - 1]
    owned[slot[: int(shard["before"])]] = False
    upper[slot[: size[0]]] = upper[slot[begin[-1] : end[-1]]] = True
    upper[depths == segment] = True
    n_end, children, leaves, saved = zeros(), zeros(), zeros(), n * words - owned * words
    n_end[last], end_conv[last] = of["n_end"], of["end_conv"]

    nodes = np.unique(slot)
    parent = trie.check[nodes]
    np.add.at(children, parent, owned[nodes].astype(np.int64))
    inside = np.zeros(slots, bool)
    inside[parent] = True
    inside[last[of["t_children"] > 0]] = True
    if shard["extended"]:
        inside[last[-1]] = True
    leaves[nodes] = ~inside[nodes]
    for total, column in ((children, "t_children"), (leaves, "t_leaves"), (saved, "t_saved")):
        total[last] += of[column]
    by_depth = nodes[np.argsort(-depths[nodes], kind="stable")]
    bounds = np.flatnonzero(np.diff(depths[by_depth])) + 1
    for group in np.split(by_depth, bounds):
        np.add.at(leaves, trie.check[group], leaves[group])
        np.add.at(saved, trie.check[group], saved[group])

    top = depths[nodes] == 0
    kind = np.where(top & (level > 0), BELOW, np.where(upper[nodes], UPPER, INNER))
    known = ~top & ~upper[parent]
    columns = [
        kind.astype(np.int32), depths[nodes] + level * segment, keys[0][nodes], keys[1][nodes],
        keys[0][parent], keys[1][parent], conv[nodes], n[nodes], children[nodes], leaves[nodes], saved[nodes],
        n_end[nodes],
    ]
    arrays = [pa.array(c) for c in columns]
    arrays.append(pa.array(end_conv[nodes], mask=n_end[nodes] == 0))
    arrays.append(pa.array(conv[parent], mask=~known))
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _NODE.split(", ")])


_LISTS = ("z1", "z2", "w", "size", *_SEQUENCE)
_SHARD = "part int, before int, extended boolean, head array<long>, tail array<long>, " + ", ".join(
    f"{c} array<long>" for c in _LISTS
)


def _shards(most: int):
    """Sorted sequences as shards, one row each. What the first and the last shard of a task cannot
    know of their neighbours is null, and their own first or last sequence is there instead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part = TaskContext.get().partitionId()
        names = ["part", "before", "extended", "head", "tail", *_LISTS]
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        types += [pa.list_(pa.int64())] * len(_LISTS)

        def row(lists: dict, before, head, following):
            end = lists["size"][-1]
            tail = [*lists["z1"][-end:], *lists["z2"][-end:]]
            extended = None if following is None else _shared(tail, following) == end
            values = [part, before, extended, head, tail if following is None else None]
            values += [lists[c] for c in _LISTS]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        lists: dict = {c: [] for c in _LISTS}
        before, head = None, None
        for batch in batches:
            for r in batch.to_pylist():
                own = [r["a1"], *[x["z1"] for x in r["turns"]], r["a2"], *[x["z2"] for x in r["turns"]]]
                n = len(own) // 2
                if not lists["size"] and head is None and before is None:
                    head = own
                elif len(lists["z1"]) >= most:
                    yield row(lists, before, head, own)
                    end = lists["size"][-1]
                    before = _shared([*lists["z1"][-end:], *lists["z2"][-end:]], own)
                    head, lists = None, {c: [] for c in _LISTS}
                lists["z1"] += own[:n]
                lists["z2"] += own[n:]
                lists["w"] += [0, *[x["w"] for x in r["turns"]]]
                lists["size"].append(n)
                for c in _SEQUENCE:
                    lists[c].append(r[c] or 0)
        if lists["size"]:
            yield row(lists, before, head, None)

    return run


def _shared(a: list, b: list) -> int:
    """Common beginning of two sequences, each its first hashes and then its second ones."""
    m, n = len(a) // 2, len(b) // 2
    return min(common(a[:m], b[:n]), common(a[m:], b[n:]))


def _neighbours(shards: DataFrame) -> DataFrame:
    """(part, before, extended) for the first and the last shard of each task; one row per task."""
    ends = shards.where("head is not null or tail is not null").groupBy("part")
    ends = ends.agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    ends = ends.coalesce(1).sortWithinPartitions("part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for r in batch.to_pylist():
                n = _shared(last, r["head"]) if last is not None else 0
                if rows:
                    rows[-1][2] = n == len(last) // 2
                rows.append([r["part"], n, False])
                last = r["tail"]
        columns = list(zip(*rows)) or [[], [], []]
        types = (pa.int32(), pa.int32(), pa.bool_())
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "_before", "_extended"])

    return ends.mapInArrow(run, "part int, _before int, _extended boolean")


def _level_nodes(sequences: DataFrame, level: int, segment: int, shard: int) -> DataFrame:
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["a1", "a2", "turns"]
    dealt = sequences.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = written(dealt.mapInArrow(_shards(shard), _SHARD), "shards")
    shards = shards.join(F.broadcast(_neighbours(shards)), "part").withColumns({
        "before": F.coalesce("before", "_before"), "extended": F.coalesce("extended", "_extended"),
    })

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("before", "extended")}
                row = {c: v.as_py() for c, v in row.items()}
                row |= {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in _LISTS}
                yield shard_nodes(row, level, segment)

    shards = shards.select("before", "extended", *_LISTS)
    return written(shards.mapInArrow(nodes, _NODE), "trie-nodes")


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, ``i``, ``k1``, ``k2``, ``w``): the turns of each conversation in order, numbered from 0, as two
    hashes and the number of words.

    In order of ``turn`` (null first), then role, then text; null roles and texts are empty ones. Rows
    without a conversation's id belong to none and are left out.
    """
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    kept = [
        F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2"),
        F.regexp_count("text", F.lit(f"[^{BLANKS}]+")).cast("long").alias("w"),
    ]
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return numbered(rows, "conv", order, kept)


def with_shared_beginnings(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: ``(convs, rows)`` as :func:`prefix_nodes` takes them.

    Conversation c begins with the first h turns of conversation c - c % ``every``, where h is the CRC-32
    of c in decimal modulo ``most`` (all of them if it has fewer, none if it is not there), and goes on with
    its own turns after its first h.
    """
    counts = written(rows.groupBy("conv").agg(F.count("*").alias("had")), "conversations")
    convs = counts.select("conv", F.crc32(F.col("conv").cast("string").cast("binary")).alias("h"))
    convs = convs.select("conv", F.pmod("h", F.lit(most)).alias("h"), (F.col("conv") - F.col("conv") % every).alias("first"))
    base = counts.select(F.col("conv").alias("first"), "had")
    convs = convs.join(base, "first", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("had", F.lit(0)))).drop("had")
    convs = written(convs, "rebuilt-conversations")
    own = rows.join(convs.select("conv", "h", "taken"), "conv").where("i >= h")
    own = own.select("conv", (F.col("taken") + F.col("i") - F.col("h")).alias("place"), "k1", "k2", "w")
    # At most ``every`` conversations begin with the turns of one, and with less than ``most`` of them.
    given = rows.where((F.col("conv") % every == 0) & (F.col("i") < most)).withColumnRenamed("conv", "first")
    taken = convs.where("taken > 0").select("conv", "first", "taken").join(given, "first").where("i < taken")
    taken = taken.select("conv", F.col("i").alias("place"), "k1", "k2", "w")
    return convs.select("conv"), written(own.union(taken), "rebuilt-turns")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, z1, z2, ``digest``) of (depth, z1, z2, conv): SHA-256 of the ids of each node in order.

    Ids are joined where they lie after a shuffle by ranges; one task then takes the hash of a
    node's joined ids row by row, which is all that must happen in order.
    """
    key = ["depth", "z1", "z2"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select(*key, "conv").repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, size = None, 0, [], 0

        def row():
            values = [*now, first, ",".join(ids)]
            arrays = [pa.array([v], t) for v, t in zip(values, [pa.int64()] * 4 + [pa.string()])]
            return pa.RecordBatch.from_arrays(arrays, names=[*key, "first", "ids"])

        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if own != now or size >= JOINED:
                    if now is not None:
                        yield row()
                    now, first, ids, size = own, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if now is not None:
            yield row()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            values = [*now, state.hexdigest()]
            arrays = [pa.array([v], t) for v, t in zip(values, [pa.int64()] * 3 + [pa.string()])]
            return pa.RecordBatch.from_arrays(arrays, names=[*key, "digest"])

        for batch in batches:
            for r in batch.to_pylist():
                own = [r[c] for c in key]
                if own != now:
                    if now is not None:
                        yield row()
                    now, state = own, hashlib.sha256(r["ids"].encode())
                else:
                    state.update(("," + r["ids"]).encode())
        if now is not None:
            yield row()

    joined = dealt.mapInArrow(join, "depth long, z1 long, z2 long, first long, ids string")
    joined = joined.repartition(*key).sortWithinPartitions(*key, "first")
    return joined.mapInArrow(digest, "depth long, z1 long, z2 long, digest string")


def prefix_nodes(
    convs: DataFrame, rows: DataFrame, segment: int = SEGMENT, shard: int = SHARD
) -> DataFrame:
    """One row per distinct beginning of the conversations: ``conv_id`` (the smallest that begins so),
    ``depth`` (turns), ``parent_conv_id`` (conv_id of the beginning one turn shorter), ``n_convs``, ``n_children``,
    ``n_leaves`` (beginnings that nothing goes on from, at or below it), ``saved_tokens`` (over it and all below
    it: conversations but one, times words of the last turn) and ``ends_sha256`` (of the ids of
    conversations that are just this beginning, ascending, joined by commas).

    ``convs`` (conv) has each conversation once, ``rows`` (conv, place, k1, k2, w) its turns at places 0, 1, ...
    with two hashes of role and text and the number of words. A conversation without turns is a
    member of the root alone. No conversations give no rows. Prefixes are told apart by 128 bits.
    """
    rows = rows.select(
        "conv", "place", "w", F.xxhash64("place", "k1", "k2").alias("z1"),
        F.xxhash64("k2", F.lit(7), "k1", "place").alias("z2"),
    )
    whole = rows.groupBy("conv").agg(
        F.count("*").alias("turns"), F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2")
    )
    none = F.lit(0).cast("long")
    whole = convs.join(whole, "conv", "left").select(
        "conv", *[F.coalesce(c, none).alias(c) for c in ("turns", "z1", "z2")]
    )
    whole = written(whole, "whole-conversations")
    longest = whole.agg(F.max("turns")).first()[0]
    levels = max(1, -(-(longest or 0) // segment))

    turn = F.struct("place", "z1", "z2", "w")
    cut = rows.withColumn("level", F.floor(F.col("place") / segment)).groupBy("conv", "level").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2")
    )
    cut = cut.withColumn("turns", F.transform("turns", lambda t: t.dropFields("place")))
    kind = cut.schema["turns"].dataType
    empty = whole.where("turns = 0").select(
        "conv", none.alias("level"), F.array().cast(kind).alias("turns"), none.alias("x1"), none.alias("x2")
    )
    cut = cut.union(empty)
    if levels > 1:
        earlier = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        start = {a: F.coalesce(F.bit_xor(x).over(earlier), none) for a, x in (("a1", "x1"), ("a2", "x2"))}
        cut = written(cut.withColumns(start), "segments")
    else:
        cut = cut.withColumns({"a1": none, "a2": none})
    cut = cut.join(whole.select("conv", F.col("turns").alias("all")), "conv")
    last = F.col("all") <= (F.col("level") + 1) * segment
    distinct = cut.groupBy("level", "a1", "a2", "turns").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.count_if(last).alias("n_end"),
        F.min(F.when(last, F.col("conv"))).alias("end_conv"),
        F.min(F.col("a1").bitwiseXOR(F.col("x1"))).alias("e1"), F.min(F.col("a2").bitwiseXOR(F.col("x2"))).alias("e2"),
    )
    distinct = written(distinct, "sequences")

    found, below = None, None
    for level in reversed(range(levels)):
        own = distinct.where(F.col("level") == level)
        if below is None:
            own = own.withColumns({c: none for c in ("t_children", "t_leaves", "t_saved")})
        else:
            own = own.join(below, ["e1", "e2"], "left")
        nodes = _level_nodes(own.select("a1", "a2", "turns", *_SEQUENCE), level, segment, shard)
        below = nodes.where(F.col("kind") == BELOW).groupBy(F.col("z1").alias("e1"), F.col("z2").alias("e2")).agg(
            *[F.sum(c).alias("t_" + c) for c in ("children", "leaves", "saved")]
        )
        found = nodes if found is None else found.union(nodes)

    key = ["depth", "z1", "z2"]
    upper = found.where(F.col("kind") == UPPER).groupBy(*key, "p1", "p2").agg(
        *[F.min(c).alias(c) for c in ("conv", "end_conv", "above")],
        *[F.sum(c).alias(c) for c in _COUNTS],
    )
    upper = written(upper, "upper-nodes")
    columns = [*key, "p1", "p2", "conv", *_COUNTS, "end_conv", "above"]
    nodes = found.where(F.col("kind") == INNER).select(*columns).union(upper.select(*columns))
    parents = upper.select(
        (F.col("depth") + 1).alias("depth"), F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv").alias("over")
    )
    nodes = nodes.where("above is not null or depth = 0").unionByName(
        nodes.where("above is null and depth > 0").join(parents, ["depth", "p1", "p2"])
        .withColumn("above", F.col("over")).select(*columns)
    )
    nodes = written(nodes, "nodes")

    many = nodes.where("n_end > 1").select(*key)
    ends = whole.withColumnRenamed("turns", "depth").join(many, key, "left_semi")
    digests = _ends_digests(ends)
    alone = F.when(F.col("n_end") == 0, F.lit("")).otherwise(F.col("end_conv").cast("string"))
    out = nodes.join(digests, key, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(alone, 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The nodes of conversations as they are; see :func:`turn_rows` and :func:`prefix_nodes`."""
    rows = turn_rows(conversations, conv_col)
    rows = written(rows.withColumnRenamed("i", "place"), "turns")
    return prefix_nodes(rows.select("conv").distinct(), rows)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_nodes(*with_shared_beginnings(rows))


SQL = r"""
with rows0 as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (
            partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')
        ) - 1 as i
    from conversations where conv_id is not null
),
convs as (
    select conv_id, conv_id - conv_id % 20 as first, xor(list_reduce(
        list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::bigint),
        lambda crc, byte: list_reduce(
            range(0, 8), lambda a, k: xor(a // 2, 3988292384 * (a % 2)), xor(crc, byte)
        ), 4294967295), 4294967295) % 4 as h
    from (select distinct conv_id, conv_id::varchar as s from rows0)
),
rebuilt as (
    select c.conv_id, r.i, r.role, r.text from convs c join rows0 r on r.conv_id = c.first and r.i < c.h
    union all
    select c.conv_id, r.i, r.role, r.text from convs c join rows0 r on r.conv_id = c.conv_id and r.i >= c.h
),
seqs as (
    select c.conv_id, coalesce(list({'r': r.role, 't': r.text} order by r.i) filter (r.i is not null), []) as seq
    from convs c left join rebuilt r on r.conv_id = c.conv_id group by c.conv_id
),
nodes as (
    select seq[:depth] as key, depth, min(conv_id) as conv_id, count(*) as n_convs,
        string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = len(seq)) as ends
    from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as depth from seqs) group by 1, 2
),
words as (
    select *, case when depth = 0 then 0
        else len(regexp_extract_all(key[depth].t, '[^\x20\x09-\x0D]+')) end as w from nodes
),
kids as (select key[:depth - 1] as key, count(*) as n_children from nodes where depth > 0 group by 1),
below as (
    select v.key[:d] as key, sum(case when k.key is null then 1 else 0 end) as n_leaves,
        sum((v.n_convs - 1) * v.w) as saved_tokens
    from (select *, unnest(range(0, depth + 1)) as d from words) v left join kids k on k.key = v.key
    group by 1
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::bigint as n_children,
    b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join below b on b.key = n.key
left join kids k on k.key = n.key
left join nodes p on n.depth > 0 and p.key = n.key[:n.depth - 1]
"""
