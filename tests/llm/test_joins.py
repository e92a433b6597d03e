import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cleanlake.llm import decontamination, jaccard_join
from cleanlake.llm.decontamination import align, leaks, words_of
from cleanlake.llm.jaccard_join import class_of, components, shingle_sets, signatures, similar_groups
from llm_data import SCHEMA


def plain_set(text):
    own = (text or "").encode().lower().split()
    if len(own) >= 5:
        return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    return frozenset([tuple(own)] if own else [])


def plain_groups(rows):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for (i, _), s, g in zip(rows, sets, group):
        ids = [j for (j, _), h in zip(rows, group) if h == g and j is not None]
        out.append((str(i), len(s), str(min(ids, default=i))))
    return sorted(out)


def found(frame):
    return sorted((str(r[0]), r[1], str(r[2])) for r in frame.collect())


def test_sets_and_classes(odd_texts):
    texts = [t for _, t in odd_texts]
    sets, want = shingle_sets(texts), [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for a, x in zip(sets, want):
        for b, y in zip(sets, want):
            assert (class_of(a) == class_of(b)) == (x == y)
    whole = shingle_sets([texts[10]])[0]
    assert (whole == sets[10]).all(), "neighbours in a batch change nothing"


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 260), st.floats(0.8, 1), st.integers(0, 1 << 30), st.integers(0, 3))
def test_similar_sets_share_a_signature(size, part, seed, family):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
    shared = rng.permutation(a)[: max(1, int(np.ceil(part * len(a))))]
    most = int(len(shared) / 0.8) - len(a)
    extra = rng.integers(0, 1 << 63, int(rng.integers(0, most + 1)) if most > 0 else 0)
    b = np.unique(np.concatenate([shared, extra.astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    who, _, signature, _ = signatures([a, b], family)
    if 100 * both >= 80 * (len(a) + len(b) - both):
        assert set(signature[who == 0].tolist()) & set(signature[who == 1].tolist())


def test_groups_of_odd_texts(docs, odd_texts):
    assert found(similar_groups(docs(odd_texts))) == plain_groups(odd_texts)


def near_copies(rng, groups=12, copies=9, size=60):
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size + rng.randint(0, 40))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 400)}"
            rows.append((i, " ".join(own)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_groups_of_near_copies(spark, monkeypatch):
    rows = near_copies(random.Random(2))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert found(similar_groups(frame)) == want
    monkeypatch.setattr(jaccard_join, "LARGE", 3)  # most buckets are large
    assert found(similar_groups(frame)) == want


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert similar_groups(none).count() == 0
    tests = spark.createDataFrame([(1, "a test item of a few words")], "item_id long, text string")
    assert leaks(none, tests).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    group = {}
    for a, b in edges:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                group[n] = x
    got = {r.c: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(g) for n, g in group.items() if len(g) > 1}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(-1, 4), max_size=25))
def test_alignment_is_smith_waterman(item, text):
    def plain(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, row[-1] - 1))
            rows.append(row)
        return max(map(max, rows))

    score, start, end = align(np.array(item), np.array(text, np.int64))
    assert score == plain(item, text)
    if score:
        assert plain(item, text[start:end]) == score


def test_edited_copies_are_leaks(spark, docs, odd_texts):
    rng = random.Random(3)
    items = [(k, " ".join(f"t{rng.randint(0, 900)}" for _ in range(rng.randint(15, 50)))) for k in range(30)]
    rows, want = list(odd_texts), set()
    for n in range(120):
        k = rng.randrange(30)
        words = items[k][1].split()
        for _ in range(len(words) // 8):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
        around = [f"u{rng.randint(0, 900)}" for _ in range(rng.randint(0, 300))]
        at = rng.randint(0, len(around))
        rows.append((1000 + n, " ".join(around[:at] + words + around[at:]).upper() + "."))
        want.add((1000 + n, k))
    rows.append((5000, " ".join(items[3][1].split()[:6])))  # a phrase alone is no leak
    tests = [*items, (77, None), (78, ""), (79, "two words"), (3, items[3][1])]
    tests = spark.createDataFrame(tests, "item_id long, text string")
    for block in (decontamination.BLOCK_CHARS, 900):
        got = {(r.doc_id, r.item_id) for r in leaks(docs(rows), tests, block_chars=block).collect()}
        assert got == want


def test_exact_passages_of_the_benchmark(spark):
    folder = "/root/testdata/sf0.01"
    out = decontamination.op4_decontamination(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    items = [(r.item_id, " ".join(words_of(r.text))) for r in items]
    exact = {(d.doc_id, k) for d in docs for k, t in items if t in " ".join(words_of(d.text))}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in out}


def test_groups_of_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(jaccard_join.op8_jaccard_join(spark, folder)) == plain_groups(rows)


def test_short_items_with_many_words_replaced(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (15, 15, 15, 20, 25, 45) for _ in range(3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(items)]  # exact copies make all 3-grams equally frequent
    for own in items:
        for share in (0.25, 0.33):
            for _ in range(12):
                copy = [f"new{rng.random()}" if rng.random() < share else w for w in own]
                around = [" ".join(rng.choices(vocabulary, k=20)) for _ in range(2)]
                rows.append((len(rows), f"{around[0]} {' '.join(copy)} {around[1]}"))
    # Every third word replaced: no three words in a row are left.
    rows.append((len(rows), " ".join("new" if k % 3 == 2 else w for k, w in enumerate(items[0]))))
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)]) for _, t in rows]
    wanted = set()
    for i, own in enumerate(items):
        if len(own) < decontamination.SHORT:
            item = np.array([numbers[w] for w in own])
            wanted |= {(d, i) for d, t in enumerate(coded) if align(item, t)[0] >= len(own)}
    assert (len(rows) - 1, 0) in wanted and len(wanted) > 150
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = leaks(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert {(d, i) for d, i in got if len(items[i]) < decontamination.SHORT} == wanted
    assert {(i, i) for i in range(len(items))} <= got


def test_benchmark_items_without_id_and_repeated_ones(spark):
    """Items without an id are sought; one item thousands of times is one item; blocks have bounded size."""
    from cleanlake.llm import decontamination

    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 350, 50)]
    items = [(1, texts[0])] * 4_000 + [(None, texts[1]), (2, None), (3, texts[2]), (None, "")]
    tests = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = [(k, f"before it all {t} and behind it") for k, t in enumerate(texts)] + [(None, texts[1])]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for chars in (decontamination.BLOCK_CHARS, 400):
        found = decontamination.row_leaks(docs, tests, block_chars=chars).select("doc_id", "item").collect()
        assert sorted(map(str, {tuple(r) for r in found})) == sorted(map(str, [(0, 1), (1, None), (2, 3), (None, None)]))
        assert len(found) == 4
    plain = tests.selectExpr("item_id as item", "text").where("text is not null").distinct()
    many = spark.range(200).selectExpr("id as item", "repeat('some words ', 10) as text")
    for frame, most in ((plain, 400), (many, 1_000)):
        blocks = decontamination._blocks_of(frame, most)
        sizes = [b.selectExpr("sum(length(text))").first()[0] or 0 for b in blocks]
        assert sum(sizes) == frame.selectExpr("sum(length(text))").first()[0] and max(sizes) <= most
