import os

import pytest

from cleanlake.operators import ghosts, removal
from cleanlake.plans.remove import run_removal
from cleanlake.plans.scan import run_scan
from cleanlake.plans.staging import Staging
from cleanlake.sources import inventory
from cleanlake.sources.inventory import file_inventory
from cleanlake.sources.tables import read_tables, table_bytes
from cleanlake.streaming.scan import found_ghosts, watch_storage

LINKED, UNLINKED = "aa11" * 10, "aa22" * 10


@pytest.fixture
def root(tmp_path):
    def put(path, content):
        target = tmp_path / "data" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)

    put(f"filedir/aa/11/{LINKED}", b"linked")
    put(f"filedir/aa/22/{UNLINKED}", b"%PDF-1.4 unlinked")
    put("filedir/aa/.dotfile", b"x")
    put("filedir/.dotdir/name", b"x")
    put("filedir/aa/22/.dotdir/deep/name", b"x")
    put("filedir/top", b"")
    put("filedir/_underscored", b"under")
    put("filedir/a/b/c/d/deep", b"<html>")
    put("other/ignored", b"x")
    (tmp_path / "data" / "filedir" / "empty").mkdir()
    return str(tmp_path / "data")


EXPECTED = {
    f"filedir/aa/11/{LINKED}": 6,
    f"filedir/aa/22/{UNLINKED}": 17,
    "filedir/top": 0,
    "filedir/_underscored": 5,
    "filedir/a/b/c/d/deep": 6,
}


@pytest.fixture
def files(table):
    return table("files", [(1, LINKED, 1, "c", "a", 0, "/", "n", 6, 1, "x", 0, 0)])


@pytest.mark.parametrize("levels", [0, 1, 2, 7])
def test_inventory_lists_the_tree(spark, root, levels):
    listing = file_inventory(spark, root, fanout_levels=levels, parallelism=3).collect()
    assert {r.path: r.length for r in listing} == EXPECTED
    assert all(r.contenthash == os.path.basename(r.path) for r in listing)


def test_a_flat_directory_is_listed_in_batches(tmp_path, monkeypatch):
    (tmp_path / "flat").mkdir()
    for i in range(250):
        (tmp_path / "flat" / f"f{i}").write_bytes(b"")
    walked = []
    real = inventory._children

    def counted(*args):
        for child in real(*args):
            walked.append(child)
            yield child

    monkeypatch.setattr(inventory, "_children", counted)
    filesystem, base = inventory.open_root(str(tmp_path))
    batches = inventory.list_entries(filesystem, base, [("flat", True, 0)], True, batch=100)
    assert len(next(batches)) == 100 and len(walked) == 100
    assert [len(b) for b in batches] == [100, 50]


def test_inventory_of_a_missing_area_is_empty(spark, root):
    assert file_inventory(spark, root, area="nowhere", parallelism=2).count() == 0


def test_scan_registers_ghosts_only(spark, root, files, table, tmp_path):
    registry = table(
        "ghost_registry", [(5, "filedir/top", "old/type", 99), (9, "filedir/gone", "old/type", 1)]
    )
    updated, found = run_scan(spark, root, files, registry, Staging(spark, str(tmp_path / "stage")))
    rows = {r.path: r for r in updated.collect()}
    assert {p: (r.mime, r.size, r.change) for p, r in rows.items()} == {
        "filedir/top": ("application/x-empty", 0, "updated"),
        "filedir/gone": ("old/type", 1, "untouched"),
        f"filedir/aa/22/{UNLINKED}": ("application/pdf", 17, "inserted"),
        "filedir/_underscored": ("text/plain", 5, "inserted"),
        "filedir/a/b/c/d/deep": ("text/html", 6, "inserted"),
    }
    assert rows["filedir/top"].id == 5 and rows["filedir/gone"].id == 9
    assert sorted(r.id for r in rows.values()) == [5, 9, 10, 11, 12]
    assert (found.first().n_files, found.first().n_bytes) == (4, 28)


def test_first_scan_numbers_from_one(spark, table):
    scan = spark.createDataFrame(
        [(f"filedir/{i}", "m", i) for i in range(500)], "path string, mime string, size bigint"
    )
    first = ghosts.upsert_registry(table("ghost_registry", []), scan)
    assert sorted(r.id for r in first.collect()) == list(range(1, 501))
    again = ghosts.upsert_registry(first.drop("change"), scan)
    assert {r.change for r in again.collect()} == {"updated"}
    assert again.drop("change").exceptAll(first.drop("change")).count() == 0


def test_dry_run_leaves_files_and_a_real_run_reports_each(spark, root):
    paths = spark.createDataFrame(
        [(f"filedir/aa/22/{UNLINKED}",), (f"filedir/aa/22/{UNLINKED}",), ("filedir/none",), ("filedir/aa",)],
        "path string",
    )
    planned = removal.unlink_files(paths, root).collect()
    assert {r.status for r in planned} == {"planned"} and len(planned) == 3
    assert os.path.exists(f"{root}/filedir/aa/22/{UNLINKED}")
    done = {r.path: r.status for r in removal.unlink_files(paths, root, dry_run=False).collect()}
    assert done == {
        f"filedir/aa/22/{UNLINKED}": "removed",
        "filedir/none": "absent",
        "filedir/aa": "error",
    }
    assert not os.path.exists(f"{root}/filedir/aa/22/{UNLINKED}")
    assert os.path.exists(f"{root}/filedir/aa/11/{LINKED}")


def test_report_pages(table):
    rows = [(i, f"p{i:03}", "m", i % 7) for i in range(40)]
    registry = table("ghost_registry", rows)
    expected = [r[1] for r in sorted(rows, key=lambda r: (-r[3], r[1]))]
    by_page = [
        [r.path for r in ghosts.ghost_report(registry, page, 15).collect()] for page in range(3)
    ]
    assert sum(by_page, []) == expected
    last = ghosts.ghost_report(registry, 0, 15).collect()[-1]
    after = ghosts.ghost_report(registry, 0, 15, after=(last["size"], last["path"]))
    assert [r.path for r in after.collect()] == expected[15:30]


def test_totals_of_an_empty_registry(table):
    assert tuple(ghosts.ghost_totals(table("ghost_registry", [])).first()) == (0, 0, 0.0)


def test_still_unlinked(table, files, ids):
    registry = table("ghost_registry", [(1, f"filedir/aa/11/{LINKED}", "m", 1), (2, "filedir/x", "m", 1)])
    assert ids(ghosts.still_unlinked(registry, files)) == [2]


def test_tables_that_exist(spark, tmp_path, files):
    files.write.parquet(str(tmp_path / "files"))
    found = read_tables(spark, ["files", "logstore_lanalytics_log"], str(tmp_path))
    assert list(found) == ["files"] and found["files"].count() == 1
    files.createOrReplaceTempView("files")
    assert list(read_tables(spark, ["files", "no_such_table"])) == ["files"]
    size = sum(
        os.path.getsize(tmp_path / "files" / f)
        for f in os.listdir(tmp_path / "files")
        if f.startswith("part-")
    )
    assert table_bytes(spark, str(tmp_path / "files")).first().bytes == size


def test_stream_of_storage_notices(spark, files, tmp_path):
    source, target = str(tmp_path / "notices"), str(tmp_path / "found")
    schema = "path string, length bigint"
    notices = [(f"filedir/aa/11/{LINKED}", 6), ("filedir/x/new", 3), ("filedir/x/new", 4)]
    spark.createDataFrame(notices, schema).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        writer = watch_storage(stream, lambda: files, target, str(tmp_path / "ckpt"))
        writer.trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.path, r.length) for r in spark.read.parquet(target).collect())

    assert run() == [("filedir/x/new", 4)]
    spark.createDataFrame([("filedir/y/more", 1)], schema).write.mode("append").parquet(source)
    assert run() == [("filedir/x/new", 4), ("filedir/y/more", 1)]


def test_ghosts_of_a_stream_are_read_once_per_path(spark, files, tmp_path):
    target = str(tmp_path / "found")
    rows = [(0, "filedir/x", "x", 1), (1, "filedir/x", "x", 5), (1, f"filedir/{LINKED}", LINKED, 6)]
    for batch, *row in rows:
        frame = spark.createDataFrame([tuple(row)], "path string, contenthash string, length bigint")
        frame.write.mode("append").parquet(f"{target}/batch={batch}")
    found = found_ghosts(spark, target, files).collect()
    assert [tuple(r) for r in found] == [("filedir/x", "x", 5)]


def test_registry_presence(table):
    registry = table("ghost_registry", [(1, "filedir/a", "m", 1), (2, "filedir/b", "m", 1)])
    listing = table("inventory", [("filedir/a", "a", 1)])
    got = ghosts.registry_presence(registry, listing).collect()
    assert {(r.id, r.present) for r in got} == {(1, True), (2, False)}


def test_removing_a_file(spark, root, table, tmp_path):
    def file(i, content):
        return (i, content, 1, "c", "a", 0, "/", f"n{i}", 2**20, 1, "x", 0, 0)

    files = table("files", [file(1, UNLINKED), file(2, UNLINKED), file(3, LINKED), file(4, "lost"), file(5, "d")])
    listing = file_inventory(spark, root, parallelism=2)
    chosen = spark.createDataFrame([(1,), (4,), (5,)], "id bigint")
    # A directory in place of content 5 makes unlinking fail.
    listing = listing.unionByName(table("inventory", [("filedir/a/b/c/d", "d", 1)]))
    args = (spark, files, listing, chosen)
    planned = run_removal(*args, str(tmp_path / "dry"), root)
    assert {r.status for r in planned["unlinked"].collect()} == {"planned"}
    assert "files" not in planned, "a dry run writes no new table"
    assert os.path.exists(f"{root}/filedir/aa/22/{UNLINKED}")
    done = run_removal(*args, str(tmp_path / "real"), root, dry_run=False)
    assert {r.path: r.status for r in done["unlinked"].collect()} == {
        f"filedir/aa/22/{UNLINKED}": "removed",
        "filedir/a/b/c/d": "error",
    }
    assert sorted(r.id for r in done["files"].collect()) == [3, 5]
    summary = {r.id: (r.status, r.n_records, r.size_mib) for r in done["summary"].collect()}
    assert summary == {1: ("content", 2, 1.0), 4: ("record_only", 1, 1.0), 5: ("content", 1, 1.0)}
