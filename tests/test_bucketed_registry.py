import glob
import os

import pytest

from cleanlake.operators.bucketed_registry import BucketedRegistry
from cleanlake.operators.ghosts import upsert_registry
from cleanlake.plans.staging import Staging

BUCKETS = 8


@pytest.fixture
def stored(spark, table, tmp_path):
    registry = BucketedRegistry(spark, str(tmp_path / "registry"), BUCKETS)
    registry.create(table("ghost_registry", [(i, f"filedir/{i}", "m", i) for i in range(1, 61)]))
    return registry


def scan_of(spark, rows):
    return spark.createDataFrame(rows, "path string, mime string, size long")


def files_of(registry):
    found = glob.glob(f"{registry.location}/bucket=*/*.parquet")
    return {f: os.stat(f).st_mtime_ns for f in found}


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def upsert(spark, registry, scan, tmp_path):
    with Staging(spark, str(tmp_path / "staging")) as staging:
        return {r["change"]: r["rows"] for r in registry.upsert(scan, staging).collect()}


def test_only_changed_buckets_are_written(spark, stored, tmp_path):
    before, files = rows_of(stored.read()), files_of(stored)
    assert len(files) == BUCKETS
    # Two differ, one is new, all others are met as they are or not at all.
    rows = [(f"filedir/{i}", "m", i) for i in range(3, 31)]
    scan = scan_of(spark, [*rows, ("filedir/1", "other", 1), ("filedir/2", "m", 99), ("filedir/new", None, 5)])
    want = upsert_registry(stored.read(), scan).drop("change")
    want = rows_of(want.select("id", "path", "mime", "size"))
    assert upsert(spark, stored, scan, tmp_path) == {"inserted": 1, "updated": 2, "same": 28, "untouched": 30}
    assert rows_of(stored.read()) == want != before
    after = files_of(stored)
    kept = {f for f in files if after.get(f) == files[f]}
    assert BUCKETS - 3 <= len(kept) < BUCKETS

    # The same scan again changes nothing and writes nothing.
    assert upsert(spark, stored, scan, tmp_path) == {"same": 31, "untouched": 30}
    assert files_of(stored) == after and rows_of(stored.read()) == want


def test_empty_scan_and_empty_registry(spark, table, stored, tmp_path):
    files = files_of(stored)
    assert upsert(spark, stored, scan_of(spark, []), tmp_path) == {"untouched": 60}
    assert files_of(stored) == files
    other = BucketedRegistry(spark, str(tmp_path / "other"), BUCKETS)
    other.create(table("ghost_registry", []))
    assert upsert(spark, other, scan_of(spark, [("a", "m", 1), ("b", "m", 2)]), tmp_path) == {"inserted": 2}
    assert [r[1] for r in rows_of(other.read())] and {r[0] for r in rows_of(other.read())} == {1, 2}


def test_removal_leaves_other_buckets(spark, stored, tmp_path):
    files = files_of(stored)
    folder = sorted(files)[0].rpartition("/")[0]
    whole = [r["path"] for r in spark.read.parquet(folder).select("path").collect()]
    with Staging(spark, str(tmp_path / "staging")) as staging:
        stored.remove(spark.createDataFrame([(p,) for p in [*whole, "unknown"]], "path string"), staging)
    assert not os.path.exists(folder)
    assert len(rows_of(stored.read())) == 60 - len(whole)
    assert all(files_of(stored).get(f) == t for f, t in files.items() if not f.startswith(folder + "/"))
