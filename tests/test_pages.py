import pytest

from cleanlake.operators import pages, search
from cleanlake.plans.staging import Staging
from cleanlake.policy import FileFilter

FILTER = FileFilter(min_mib=-1)


@pytest.fixture
def found(spark, table, tmp_path):
    rows = [
        (i, f"h{i % 83:02d}", 1, "user", "content", 0, "/", f"f{i}.pdf", i, i % 7 or None, "x", 1, 1) for i in range(300)
    ]
    files = table("files", rows).repartition(4)
    users = table("user", [(i, f"first{i}", "last", i % 2) for i in range(1, 6)])
    with Staging(spark, str(tmp_path)) as staging:
        yield files, users, pages.content_pages(files, users, FILTER, staging, 5)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("size", [7, 40])
def test_every_page_equals_the_sorted_one(found, size):
    files, users, contents = found
    assert contents.total == 83
    seen = []
    for number in range(-(-83 // size) + 1):
        page = contents.page(number, size)
        want = search.find_files(files, users, FILTER, size, number * size)
        assert rows_of(page.select(*want.columns)) == rows_of(want)
        seen += [r["contenthash"] for r in page.collect()]
    assert len(seen) == len(set(seen)) == 83


def test_a_page_reads_its_ranges_only(found):
    _, _, contents = found
    assert len(contents.before) == 6 and contents.before[-1] == 83
    for k, (low, high) in enumerate(zip(contents.before, contents.before[1:])):
        assert high == low or contents.ranges(low, high) == [k]
    whole = contents.ranges(0, 83)
    assert len(contents.ranges(40, 41)) == 1 < len(whole)
    plan = contents.page(1, 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort [contenthash" not in plan
    assert "PartitionFilters: [part" in plan.replace("PartitionFilters: [isnotnull(part", "PartitionFilters: [part")


def test_nothing_found(spark, table, tmp_path):
    with Staging(spark, str(tmp_path)) as staging:
        contents = pages.content_pages(table("files", []), table("user", []), FILTER, staging)
        assert contents.total == 0 and contents.page(0).count() == 0
