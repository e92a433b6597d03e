import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from cleanlake.demo import queries as demo
from cleanlake.operators import aged_files, vectors
from cleanlake.operators.orphans import survivors
from cleanlake.plans.staging import Staging
from cleanlake.sources.footers import FILE, data_files, file_footers

SCHEMA = "id long, ts long, text string"


@pytest.fixture
def stored(spark, tmp_path):
    """stored(rows, files, partition column): the folder of a table and its rows."""

    def make(rows, files=4, by=None, name="table"):
        folder = str(tmp_path / name)
        frame = spark.createDataFrame(rows, SCHEMA + (f", {by} string" if by else ""))
        frame = frame.repartitionByRange(files, "ts")
        (frame.write.partitionBy(by) if by else frame.write).parquet(folder)
        return folder

    return make


def local(file):
    return "/" + unquote(file).removeprefix("file:").lstrip("/")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_survivors_by_position_equal_the_anti_join(spark, stored):
    """Files of several blocks of a bitmap, repeated and null keys."""
    rows = [(None if i % 50 == 0 else i // 2, i, f"row {i}") for i in range(80_000)]
    folder = stored(rows, files=1)
    table = vectors.read_files(spark, folder, SCHEMA)
    doomed = spark.createDataFrame([(i,) for i in range(0, 40_000, 7)] + [(7,), (None,)], "id long")
    found = vectors.deletion_vectors(table, doomed)
    assert found.count() == 3
    want = survivors(table, doomed)
    assert rows_of(vectors.survivors_by_position(table, found)) == rows_of(want)
    assert found.agg(F.sum("deleted")).first()[0] == 80_000 - want.count()


def test_vectors_by_predicate_and_together(spark, stored):
    folder = stored([(i, i if i % 3 else None, "x") for i in range(300)])
    table = vectors.read_files(spark, folder, SCHEMA)
    one = vectors.vectors_where(table, F.col("ts") < 100)
    two = vectors.deletion_vectors(table, spark.createDataFrame([(50,), (200,)], "id long"))
    both = vectors.merged_vectors(one, two)
    kept = vectors.survivors_by_position(table, both)
    want = table.where("(ts is null or ts >= 100) and id not in (50, 200)")
    assert rows_of(kept) == rows_of(want)
    assert both.agg(F.sum("deleted")).first()[0] == 300 - want.count()
    none = vectors.vectors_where(table, F.col("ts") < 0)
    assert vectors.survivors_by_position(table, none).count() == 300


@pytest.mark.parametrize("by", [None, "part"])
@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_only_touched_files_are_written(spark, stored, tmp_path, by, share):
    """Files 1 to 4 lose none, a few, most and all of their rows."""
    rows = [(i, i, f"t{i}", *(["p" + str(i // 100)] if by else [])) for i in range(400)]
    folder = stored(rows, by=by)
    schema = SCHEMA + (", part string" if by else "")
    table = vectors.read_files(spark, folder, schema)
    before = {f: os.stat(local(f)).st_mtime_ns for f in files_of(spark, folder)}
    ids = [*range(100, 110), *range(200, 290), *range(300, 400)]
    doomed = spark.createDataFrame([(i,) for i in ids], "id long")
    version = vectors.delete_rows(
        spark, folder, schema, vectors.deletion_vectors(table, doomed), str(tmp_path / "next"),
        [by] if by else (), rewrite_above=share,
    )
    assert rows_of(version.read()) == rows_of(survivors(table, doomed).select(*version.schema.fieldNames()))
    actions = {r["deleted"]: r["action"] for r in version.manifest.collect()}
    few = {0.0: "rewritten", 0.5: "masked", 1.0: "masked"}[share]
    most = {0.0: "rewritten", 0.5: "rewritten", 1.0: "masked"}[share]
    assert actions == {0: "kept", 10: few, 90: most, 100: "dropped"}
    # Old files are as they were, and what is new has the rows of the rewritten ones alone.
    assert before == {f: os.stat(local(f)).st_mtime_ns for f in files_of(spark, folder)}
    written = 0
    if os.path.exists(version.replacements):
        written = spark.read.parquet(version.replacements).count()
    assert written == {0.0: 100, 0.5: 10, 1.0: 0}[share]


def files_of(spark, folder):
    return [r[0] for r in data_files(spark, folder).select(FILE).collect()]


def test_names_of_files_are_those_of_the_scan(spark, stored):
    folder = stored([(1, 1, "x")], by=None, name="odd name & sign")
    table = vectors.read_files(spark, folder, SCHEMA)
    seen = {r[0] for r in vectors.with_positions(table).select(FILE).collect()}
    assert seen <= set(files_of(spark, folder))
    footers = file_footers(spark, folder, "ts").where("rows > 0").collect()
    assert [(r[FILE] in seen, r["rows"], r["low"], r["high"]) for r in footers] == [(True, 1, 1, 1)]


def test_footers(spark, stored):
    folder = stored([(i, None if i < 3 else i, "x") for i in range(10)], files=1)
    found = file_footers(spark, folder, "ts").where("rows > 0").collect()
    assert [tuple(r)[1:] for r in found] == [(10, 3, 3, 9)]
    assert [tuple(r)[1:] for r in file_footers(spark, folder, "none").where("rows > 0").collect()] == [
        (10, None, None, None)
    ]
    # Texts have bounds that are no numbers.
    assert file_footers(spark, folder, "text").where("low is not null").count() == 0


def test_aged_files_are_not_read(spark, stored, tmp_path):
    rows = [(i, i, "x") for i in range(400)] + [(1000 + i, None, "null") for i in range(3)]
    folder = stored(rows, files=4)
    with Staging(spark, str(tmp_path / "s")) as staging:
        aged = aged_files.aged_table(spark, folder, SCHEMA, "ts", 150, staging)
        table = vectors.read_files(spark, folder, SCHEMA)
        assert rows_of(aged.kept()) == rows_of(table.where("ts is null or ts >= 150"))
        gone = [local(f) for f in aged.files(aged_files.AGED)]
        verdicts = {r["verdict"]: r["rows"] for r in aged.summary().collect()}
        assert set(verdicts) <= {"aged", "fresh", "mixed"} and sum(verdicts.values()) == 403
        parent = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "id long")
        spared = aged.kept_with_parent(parent, "id")
        assert rows_of(spared) == rows_of(table.where("ts >= 150 and id % 2 = 0"))
        doomed = aged.doomed(parent, "id").groupBy("reason").count().collect()
        whole = spark.read.parquet(*gone).count() if gone else 0
        assert sum(r["count"] for r in doomed) + whole == 403 - spared.count()
        # Files that are wholly aged can be missing by now: nothing reads them.
        for file in gone:
            os.remove(file)
        assert aged.kept().count() == 253


def test_times_as_timestamps(spark, tmp_path, conf):
    """Whole seconds where the file says; the old type of times has no bounds, so such files are mixed."""
    want = {"TIMESTAMP_MICROS": ((10, 0, 0, 9 * 86400), "aged"), "INT96": ((10, 0, None, None), "mixed")}
    for kind, (bounds, verdict) in want.items():
        conf({"spark.sql.parquet.outputTimestampType": kind})
        folder = str(tmp_path / kind)
        rows = spark.sql("select id, timestamp_seconds(id * 86400) as ts from range(10)")
        rows.coalesce(1).write.parquet(folder)
        assert [tuple(r)[1:] for r in file_footers(spark, folder, "ts").collect()] == [bounds]
        assert aged_files.files_by_age(spark, folder, "ts", 20 * 86400).first()["verdict"] == verdict


def test_files_of_a_folder_are_judged_as_one(spark, tmp_path):
    """A month has as many files as it needs; its verdict is that of all its rows."""
    times = {"old": [10, 20, 30, 40], "both": [20, 90, 95, 99], "new": [90, 91, 92, 93], "gap": [10, None, 20, None]}
    rows = [(i, ts, month) for month, own in times.items() for i, ts in enumerate(own)]
    frame = spark.createDataFrame(rows, "id bigint, ts bigint, month string")
    folder = str(tmp_path / "log")
    frame.repartition(4, "id").write.option("maxRecordsPerFile", 1).partitionBy("month").parquet(folder)
    assert len(list((tmp_path / "log").glob("month=old/*.parquet"))) == 4
    found = aged_files.files_by_age(spark, folder, "ts", 50, by_folder=True).collect()
    got = {r["_file"].rpartition("=")[2]: (r["rows"], r["verdict"]) for r in found}
    assert got == {"old": (4, "aged"), "both": (4, "mixed"), "new": (4, "fresh"), "gap": (4, "mixed")}


def test_no_task_writes_a_whole_month(spark, conf, monkeypatch):
    """The log lies in one month; before, one task sorted and wrote all of it."""
    conf({"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4"})
    places = []
    stored = demo._stored
    monkeypatch.setattr(demo, "_stored", lambda *a: places.append(stored(*a)) or places[-1])
    summary = demo.log_months_by_age(demo.Views(spark, "/root/testdata/sf0.001")).collect()
    files = spark.read.parquet(places[0][1]).inputFiles()
    assert len(files) >= 4 and sum(r["files"] for r in summary) == 1
