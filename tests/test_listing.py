import os

import pytest

from cleanlake.sources.inventory import file_inventory
from cleanlake.sources.listing import Folder, ListingReader, register_listing
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

HASHES = [f"{a}{b}{c}rest" for a in ("00", "0a", "ff") for b in ("11", "22") for c in range(3)]


@pytest.fixture
def root(tmp_path):
    for k, h in enumerate(HASHES):
        folder = tmp_path / "filedir" / h[:2] / h[2:4]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / h).write_bytes(b"x" * k)
    (tmp_path / "filedir" / "warning.txt").write_bytes(b"at the top")
    (tmp_path / "filedir" / ".hidden").write_bytes(b"")
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_equals_the_inventory_and_works_in_sql(spark, root):
    register_listing(spark)
    listing = spark.read.format("storage_listing").option("root", root).load()
    want = rows_of(file_inventory(spark, root))
    assert rows_of(listing) == want and len(want) == len(HASHES) + 1
    listing.createOrReplaceTempView("stored")
    found = spark.sql("select count(*) as n, sum(length) as b from stored where path like 'filedir/0a/%'").first()
    assert (found["n"], found["b"]) == (6, sum(k for k, h in enumerate(HASHES) if h.startswith("0a")))
    one = spark.sql(f"select path from stored where contenthash = '{HASHES[4]}'").collect()
    assert [r["path"] for r in one] == [f"filedir/{HASHES[4][:2]}/{HASHES[4][2:4]}/{HASHES[4]}"]
    some = spark.sql(f"select path from stored where contenthash in ('{HASHES[4]}', '{HASHES[17]}', 'none')")
    assert some.count() == 2
    assert spark.sql("select * from stored where contenthash like 'ff2%' and path like 'filedir/0%'").count() == 0
    empty = spark.read.format("storage_listing").option("root", root)
    assert empty.option("area", "empty").load().count() == 0
    assert empty.option("area", "absent").load().count() == 0
    with pytest.raises(Exception, match="root"):
        spark.read.format("storage_listing").load().count()


def listed(reader, monkeypatch):
    """Files found, and folders that were looked into."""
    from cleanlake.sources import inventory

    opened = []
    plain = os.scandir
    monkeypatch.setattr(inventory.os, "scandir", lambda p: opened.append(p) or plain(p))
    files = [f for part in reader.partitions() for b in reader.read(part) for f in b.column(0).to_pylist()]
    monkeypatch.undo()
    return files, {p.partition("filedir")[2] for p in opened}


def test_a_pushed_prefix_lists_only_its_folder(root, monkeypatch):
    reader = ListingReader(root, "filedir")
    pushed = [StringStartsWith(("path",), "filedir/0a/2"), GreaterThan(("length",), 1)]
    assert list(reader.pushFilters(pushed)) == pushed  # the engine applies them again
    files, opened = listed(reader, monkeypatch)
    assert sorted(f.rpartition("/")[2] for f in files) == [h for h in HASHES if h.startswith("0a22")]
    assert opened == {"", "/0a", "/0a/22"}
    assert reader.partitions() == [Folder("filedir/0a", True, 0)]

    reader = ListingReader(root, "filedir")
    list(reader.pushFilters([In(("contenthash",), (HASHES[0], HASHES[17]))]))
    files, opened = listed(reader, monkeypatch)
    assert opened == {"", "/00", "/00/11", "/ff", "/ff/22"}
    assert {HASHES[0], HASHES[17]} <= {f.rpartition("/")[2] for f in files}

    reader = ListingReader(root, "filedir")
    list(reader.pushFilters([EqualTo(("path",), "filedir/warning.txt")]))
    assert listed(reader, monkeypatch) == (["filedir/warning.txt"], {""})
