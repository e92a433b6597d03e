import hashlib
import re
from collections import Counter

from cleanlake.llm import line_dedup, quality
from cleanlake.llm.line_dedup import LineRuns, dedup_lines
from cleanlake.llm.quality import RULES, fit, judge
from llm_data import SCHEMA, words

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_dedup(rows, least):
    keys, seen = [[x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")] for _, t in rows], {}
    for (i, _), own in zip(rows, keys):
        for k in set(own) - {""}:
            seen.setdefault(k, set()).add(i)
    out = []
    for (i, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own) if len(seen.get(k, ())) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def found(frame):
    rows = frame.select("doc_id", "n_lines", "n_dropped", "text").collect()
    return Counter((r[0], r[1], r[2], r[3] or "") for r in rows)


def test_line_dedup_equals_brute_force(docs, odd_texts):
    for least in (1, 2, 3):
        frame = dedup_lines(docs(odd_texts), min_docs=least)
        assert found(frame) == plain_dedup(odd_texts, least)
        assert set(docs(odd_texts).columns) < set(frame.columns)


def test_runs_are_compacted_and_forget_nothing(spark):
    runs = LineRuns(spark, min_docs=4, fan_in=2)
    for batch in range(7):
        rows = [(k, k, 1) for k in range(10) if batch % (k + 1) == 0]
        runs.add(spark.createDataFrame(rows, "k1 long, k2 long, n long"))
    want = {k for k in range(10) if sum(b % (k + 1) == 0 for b in range(7)) >= 4}
    assert {r.k1 for r in runs.finish().collect()} == want
    assert all(len(level) < 2 for level in runs.levels)


def test_query_goes_through_runs_and_levels(spark, monkeypatch):
    """Of the registered query: batches meet runs of frequent keys that have rows, and a second level
    is merged."""
    met, merged = [], []
    add, compact = LineRuns.add, LineRuns._compact
    monkeypatch.setattr(
        LineRuns, "add", lambda self, batch: met.append(sum(r.count() for r in self.found)) or add(self, batch)
    )
    monkeypatch.setattr(LineRuns, "_compact", lambda self, level: merged.append(level) or compact(self, level))
    folder = "/root/testdata/sf0.001"
    out = line_dedup.op9_line_dedup(spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_dedup(rows, 10)}
    assert {tuple(r) for r in out.collect()} == want
    assert len(met) == 16 and sum(n > 0 for n in met) >= 4
    assert merged.count(0) == 4 and merged.count(1) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_lines(none).count() == 0
    assert judge(none)[0].count() == 0


def test_quality_counts_equal_brute_force(docs, odd_texts):
    rows, _ = judge(docs(odd_texts))
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in rows.collect()
    )
    want = Counter()
    for i, t in odd_texts:
        own = words(t)
        seen = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        again = set()
        for k in range(len(own) - 4):
            if seen[tuple(own[k : k + 5])] > 1:
                again.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(own) < 10 or 100 * len(again) > 20 * len(own)
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        row = (i, len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(again), failed)
        want[row] += 1
    assert got == want


def test_label_model_trusts_rules_that_agree():
    n = len(RULES)

    def vote(**cast):
        return tuple(cast.get(r.name, 0) for r in RULES)

    clean, junk = vote(prose=1, unrepeated=1), vote(symbols=-1, capitals=-1)
    wrong = vote(monotony=-1, prose=1, unrepeated=1)
    model = fit([(clean, 900), (junk, 60), (wrong, 40)])
    assert model.log_odds(clean) > 0 > model.log_odds(junk)
    assert model.log_odds(wrong) > 0, "a rule that contradicts good ones loses weight"
    right = dict(zip((r.name for r in RULES), model.right))
    assert right["monotony"] < right["symbols"]
    assert len(fit([]).right) == n


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    out = line_dedup.op9_line_dedup(spark, folder)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = plain_dedup(list(texts.items()), 10)
    got = Counter((r[0], r[1], r[2], r[3]) for r in out.collect())
    assert got == Counter(
        {(i, n, d, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, d, t), c in want.items()}
    )
    kept = quality.op3_quality(spark, folder)
    assert kept.where("not base_failed and kept").count() > 0.8 * len(texts)
