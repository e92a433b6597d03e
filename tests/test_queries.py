import __spark_entry__ as entry
from check import compare
from cleanlake.demo import checks
from cleanlake.demo import queries as demo

FOLDER = "/root/testdata/sf0.001"


def test_every_query_equals_its_sql(spark):
    assert set(checks.oracle_sql()) == set(demo.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert compare(spark, FOLDER, demo.queries()) == []


def test_flagship(spark):
    report = entry.entry(spark)
    assert report.columns == ["seq", "step", "table", "rule", "rows", "bytes", "status"]
    assert report.count() == 27
