import pytest

from cleanlake.operators import search
from cleanlake.policy import FileFilter

MIB = 1024 * 1024


@pytest.fixture
def data(table):
    def file(i, content, size, component="user", name="a.pdf", user=1, author="Z"):
        return (i, content, 1, component, "course", 0, "/", name, size, user, author, 60 * i, 0)

    files = table(
        "files",
        [
            file(1, "h1", 0),
            file(2, "h1", 1),
            file(3, "h2", 50 * MIB, "backup", "b.mbz", 2),
            file(4, "h2", 50 * MIB + 1, "backup", "c.mbz", 3),
            file(5, "h3", 60 * MIB, "mod_folder", "d.pdf", 99, "Ann Lee"),
            file(6, "h3", 60 * MIB, "mod_folder", "e.pdf", None, "Bo"),
        ],
    )
    users = table("user", [(1, "Ann", "Lee", 0), (2, "Bo", "Ray", 1), (3, "Cy", "Day", 1)])
    return files, users


def found(data, **flt):
    return sorted(r.id for r in search.find_files(*data, FileFilter(**flt)).collect())


def test_size_is_strict_and_empty_files_never_show(data):
    assert found(data) == [2, 3, 5]
    assert found(data, min_mib=50) == [4, 5]


def test_grouping_comes_after_the_filter(data):
    assert found(data, component="backup") == [3]
    assert found(data, component="backup", min_mib=50) == [4]


@pytest.mark.parametrize("blank", [None, "", "0"])
def test_blank_criteria_are_ignored(data, blank):
    assert found(data, component=blank, name_like=blank, user_like=blank, user_deleted=blank) == [2, 3, 5]


def test_user_text_matches_both_orders_and_author(data):
    assert found(data, user_like="Ann Lee") == [2, 5]
    assert found(data, user_like="Lee Ann") == [2]
    assert found(data, user_like="ann lee") == []
    assert found(data, user_like="ann lee", ) == []
    insensitive = FileFilter(user_like="ann lee", case_sensitive=False)
    assert sorted(r.id for r in search.find_files(*data, insensitive).collect()) == [2, 5]


def test_deleted_users_only(data):
    assert found(data, user_deleted=1) == [3]
    assert found(data, user_deleted=True, min_mib=50) == [4]


def test_pages_by_offset_and_by_hash(data):
    def page(**more):
        rows = search.find_files(*data, FileFilter(), **more).collect()
        return sorted((r.contenthash, r.id) for r in rows)

    assert page(limit=2) == [("h1", 2), ("h2", 3)]
    assert page(limit=2, offset=2) == [("h3", 5)]
    assert page(limit=2, after_hash="h2") == [("h3", 5)]
    assert page(limit=None) == [("h1", 2), ("h2", 3), ("h3", 5)]
    assert page(limit=20_000) == page(limit=None)


def test_found_rows_carry_their_user(data):
    rows = {r.id: r for r in search.find_files(*data).collect()}
    assert (rows[2].firstname, rows[2].user_deleted) == ("Ann", 0)
    assert (rows[5].firstname, rows[5].user_deleted) == (None, None)


def test_counts_are_of_records_while_pages_are_of_contents(data):
    row = search.count_files(*data).first()
    assert (row.n_records, row.n_contents, row.shown_total) == (5, 3, 5)
    row = search.count_files(*data, FileFilter(component="none")).first()
    assert (row.n_records, row.n_contents, row.shown_total) == (0, 0, 0)


def test_shown_total_is_capped_per_page(spark, table):
    one = (1, "h", 1, "c", "a", 0, "/", "n", 5, 1, "x", 0, 0)
    files = table("files", [(i, *one[1:]) for i in range(2500)])
    users = table("user", [])
    shown = [search.count_files(files, users, page=p).first().shown_total for p in (0, 1, 2)]
    assert shown == [1000, 2000, 2500]


def test_listing(data):
    rows = {r.id: r for r in search.file_listing(search.find_files(*data)).collect()}
    assert rows[3].place == "backup, course"
    assert rows[3].previewable and rows[5].previewable and not rows[2].previewable
    assert rows[3].user_name == "Bo Ray" and rows[3].user_deleted
    assert not rows[5].user_deleted
    assert rows[5].size_mib == 60.0
    assert rows[2].created == "1970-01-01 00:02"


def test_filters_reach_the_scan(spark, data, tmp_path):
    path = str(tmp_path / "files")
    data[0].write.parquet(path)
    files = spark.read.parquet(path)
    count = search.count_files(files, data[1], FileFilter(min_mib=5, component="backup"))
    plan = count._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(filesize,5242880)" in plan and "EqualTo(component,back" in plan
    assert "filename" not in plan.split("ReadSchema")[1]


def test_numbered_page(data):
    rows, counts = search.file_page(*data, page=0, page_size=1)
    assert [r.id for r in rows.collect()] == [4]
    rows, _ = search.file_page(*data, page=1, page_size=1)
    assert [r.id for r in rows.collect()] == [5]
    assert counts.first().n_records == 3
