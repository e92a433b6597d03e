import corpus_pipeline
from cleanlake.llm.jaccard_join import similar_groups
from cleanlake.llm.queries import oracle_sql, queries
from llm_data import SCHEMA

SF = "/root/testdata/sf0.001"


def stages(spark, docs, folder=SF):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        out[name] = docs
    return out


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stages(spark, docs)
    names = list(out)
    assert names == ["language", "line_dedup", "near_copies", "benchmark", "packing"]
    for name in names[:-1]:
        assert out[name].columns == docs.columns
    texts = {n: {r.doc_id: r.text for r in out[n].collect()} for n in names[:-1]}
    assert set(texts["language"]) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    groups = similar_groups(out["line_dedup"]).collect()
    assert set(texts["near_copies"]) == {r.component_id for r in groups}
    assert set(texts["benchmark"]) <= set(texts["near_copies"])
    packed = {r.doc_id for r in out["packing"].select("doc_id").collect()}
    assert packed == set(texts["benchmark"])
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == out["packing"].columns and run.count() == out["packing"].count()


def test_odd_and_no_documents(spark, docs, odd_texts):
    for rows in (odd_texts, []):
        own = docs(rows, extra=False)
        out = stages(spark, own)
        kept = {(r.doc_id, r.text) for r in out["benchmark"].collect()}
        assert all(any(c.isalpha() for c in t) for _, t in kept)
        assert out["near_copies"].count() == len(kept)


def test_rows_are_judged_by_their_own_text(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    fine = "a text about rivers and hills that no one has written before number"
    texts = [" ".join(f"{fine[:9]}{k}x{i}" for i in range(30)) for k in range(4)]
    own = docs([(None, item), (None, texts[0]), (7, item), (7, texts[1]), (8, texts[2])], extra=False)
    kept = corpus_pipeline.benchmark(spark, own, SF).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, texts[0]), (7, texts[1]), (8, texts[2])}

    near = texts[0] + " more"
    rows = [(None, texts[0]), (None, texts[0]), (None, near), (None, texts[1]), (5, texts[1])]
    rows += [(5, texts[2]), (3, texts[2]), (5, texts[3]), (5, texts[3]), (None, None), (None, None)]
    kept = corpus_pipeline.near_copies(spark, docs(rows, extra=False), SF).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    assert [r for r in got if r[0] is None and r[1]] in ([(None, texts[0])], [(None, near)])
    assert [r for r in got if r[0]] == [(3, texts[2]), (5, texts[1]), (5, texts[3])]
    assert got.count((None, None)) == 2


def test_no_rows_with_the_schema(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert stages(spark, none)["packing"].count() == 0


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))
    assert set(oracle_sql()) < set(queries())


def test_documents_of_blank_lines_go(spark, docs):
    """The line stage drops a document of which only blanks are left, and keeps one that had no other."""
    rows = [(k, f"A shared line.\n \t\nown line {k}" if k % 2 else "A shared line.\n \n\t") for k in range(24)]
    kept = corpus_pipeline.lines(spark, docs([*rows, (99, " \n\t")], extra=False), SF).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(k, f" \t\nown line {k}") for k in range(1, 24, 2)} | {(99, " \n\t")}
