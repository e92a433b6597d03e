import pytest

from cleanlake.__main__ import main
from cleanlake.policy import DAY, MODULE_DELETE_TASK

AS_OF = 20_000 * DAY


@pytest.fixture
def stored(table, tmp_path):
    """Tables as files, with settings, and a storage tree of three files."""
    old = AS_OF - 100 * DAY
    file = lambda i, h, name, created: (i, h, 1, "user", "content", 0, "/", name, 10, 1, "x", created, created)
    rows = {
        "config": [("cleanup_backup_timeout_days", "90"), ("cleanup_run_autoremove", "0")],
        "files": [file(1, "aa11", "a.mbz", old), file(2, "bb22", "b.pdf", old), file(3, "nowhere", "c.pdf", old)],
        "task_adhoc": [(1, MODULE_DELETE_TASK, 1, 0, "{}"), (2, "other", 0, 0, "{}")],
        "course_modules": [(5, 10, 1, 1, 1, 1), (6, 10, 1, 1, 1, 0)],
        "logstore_standard_log": [(1, 1, AS_OF - DAY), (2, 1, old)],
    }
    for name, own in rows.items():
        table(name, own).write.parquet(str(tmp_path / "tables" / name))
    for h in ("aa11", "bb22", "cc33"):
        folder = tmp_path / "data" / "filedir" / h[:2] / h[2:]
        folder.mkdir(parents=True)
        (folder / h).write_bytes(b"text of " + h.encode())
    return tmp_path


def run(spark, stored, job, *more):
    argv = [job, "--tables", str(stored / "tables"), "--as-of", str(AS_OF), *map(str, more)]
    return main(argv, spark).collect()


def test_usage(spark, stored):
    rows = {(r["item"], r["period"]): r for r in run(spark, stored, "usage")}
    assert rows["logstore_standard_log", "all"]["n"] == 2
    assert rows["grade_items_history", None]["status"] == "skipped"
    size = sum(f.stat().st_size for f in (stored / "tables" / "logstore_standard_log").glob("*.parquet"))
    assert rows["logstore_standard_log", "all"]["n_bytes"] == size


def test_requeue(spark, stored):
    found = run(spark, stored, "requeue", "--out", stored / "next", "--user", 7)
    assert {(r["classname"], r["count"]) for r in found} == {("other", 1), (MODULE_DELETE_TASK, 1)}


def test_cleanup_with_stored_settings(spark, stored):
    """Backups are kept 90 days by the settings; with auto-remove off only the check-out runs."""
    args = ("--out", stored / "next", "--root", stored / "data")
    rows = {r["rule"]: r["rows"] for r in run(spark, stored, "cleanup", *args)}
    assert rows == {"missing": 1, "content_gone": 0, "backup": 1, "draft": 0}
    assert (stored / "data/filedir/aa/11/aa11").exists()
    again = run(spark, stored, "cleanup", *args, "--resume", "nightly")
    assert {r["rule"]: r["rows"] for r in again} == rows
    assert {r["rule"]: r["rows"] for r in run(spark, stored, "cleanup", *args, "--resume", "nightly")} == rows
    run(spark, stored, "cleanup", *args, "--apply")
    assert not (stored / "data/filedir/aa/11/aa11").exists() and (stored / "data/filedir/bb/22/bb22").exists()


def test_scan(spark, stored):
    found = run(spark, stored, "scan", "--out", stored / "next", "--root", stored / "data")
    assert [(r["n_files"], r["n_bytes"]) for r in found] == [(1, 12)]
    registry = spark.read.parquet(str(stored / "next/ghost_registry")).collect()
    assert [(r["path"], r["mime"]) for r in registry] == [("filedir/cc/33/cc33", "text/plain")]


def test_bad_calls(spark, stored):
    with pytest.raises(SystemExit):
        main(["cleanup", "--tables", str(stored / "tables"), "--out", "x", "--root", "y", "--resume", "z"], spark)
    with pytest.raises(SystemExit):
        main(["usage", "--tables", str(stored / "absent")], spark)
    with pytest.raises(SystemExit):
        main(["other"], spark)
