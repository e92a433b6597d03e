from cleanlake.functions.clock import years_before
from cleanlake.operators import statistics as st

AS_OF = 1_735_689_600
Y1, Y2 = years_before(AS_OF, 1), years_before(AS_OF, 2)


def file(i, component, created, modified=0, size=10):
    return (i, f"h{i}", 1, component, "a", 0, "/", "n", size, 1, "x", created, modified)


def test_file_stats_periods_and_time_columns(table):
    files = table(
        "files",
        [
            file(1, "user", Y1 + 1),
            file(2, "user", Y1),
            file(3, "user", Y1 - 1),
            file(4, "user", Y2),
            file(5, "user", Y2 - 1),
            file(6, "backup", AS_OF, Y2),
        ],
    )
    got = {
        (r.component, r.period): (r.n_files, r.n_bytes)
        for r in st.file_stats(files, ["user", "backup", "empty"], AS_OF).collect()
    }
    assert got == {
        ("user", "all"): (5, 50),
        ("user", "last_year"): (1, 10),
        ("user", "year_before"): (2, 20),
        ("backup", "all"): (1, 10),
        ("backup", "last_year"): (0, 0),
        ("backup", "year_before"): (1, 10),
        ("empty", "all"): (0, 0),
        ("empty", "last_year"): (0, 0),
        ("empty", "year_before"): (0, 0),
    }


def test_component_stats(table):
    files = table("files", [file(i, "user", t) for i, t in enumerate([5, 10, 15])])

    def n(**period):
        return st.component_stats(files, "user", **period).first().n_files

    assert n() == 3
    assert n(since=10) == 3
    assert n(until=10) == 1
    assert n(until=10, newer=True) == 1
    assert n(until=15, since=5) == 2
    assert tuple(st.component_stats(files, "none").first()) == (0, 0)


def test_history_stats(spark, table):
    log = table(
        "logstore_standard_log",
        [(1, 1, Y1), (2, 1, Y1 - 1), (3, 1, Y2), (4, 1, Y2 - 1), (5, 1, None)],
    )
    tables = [
        st.HistoryTable("log", log, "timecreated"),
        st.HistoryTable("sized", log, "timecreated", 1000),
        st.HistoryTable("empty", table("logstore_standard_log", []), "timecreated"),
        st.HistoryTable("absent", None, "timecreated"),
    ]
    got = {
        (r.table, r.period): (r.n_rows, r.n_bytes, r.status)
        for r in st.history_stats(spark, tables, AS_OF).collect()
    }
    assert got["log", "all"] == (5, 5 * 1024, "ok")
    assert got["log", "last_year"] == (1, 1024, "ok")
    assert got["log", "year_before"] == (2, 2 * 1024, "ok")
    assert got["sized", "year_before"] == (2, 400, "ok")
    assert got["empty", "last_year"] == (0, 0, "ok")
    assert got["absent", None] == (None, None, "skipped")


def test_usage_statistics_shows_readable_sizes(spark, table):
    files = table("files", [file(1, "user", AS_OF, size=1536)])
    history = [st.HistoryTable("gone", None, "t")]
    rows = st.usage_statistics(spark, files, ["user"], history, AS_OF).collect()
    shown = {(r.section, r.item, r.period): (r.n, r.shown, r.status) for r in rows}
    assert shown["files", "user", "all"] == (1, "1.5 KB", "ok")
    assert shown["history", "gone", None] == (None, None, "skipped")


def test_one_pass_over_files(spark, table, tmp_path):
    path = str(tmp_path / "files")
    table("files", [file(1, "user", AS_OF)]).write.parquet(path)
    stats = st.file_stats(spark.read.parquet(path), ["user"], AS_OF)
    assert stats._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
