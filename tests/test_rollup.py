import random

import pytest

from cleanlake.functions.clock import years_before
from cleanlake.operators import rollup, statistics
from cleanlake.policy import DAY

AS_OF = 1735689600  # the beginning of 2025
ONE, TWO = years_before(AS_OF, 1), years_before(AS_OF, 2)
COLUMNS = "id long, component string, filesize long, timecreated long, timemodified long"
COMPONENTS = ["backup", "user", "none"]


@pytest.fixture
def files(spark):
    """Times at, one second beside, and one day beside each bound; null times, sizes and components."""
    chance = random.Random(1)
    times = [None] + [b + d for b in (ONE, TWO, AS_OF) for d in (-DAY, -1, 0, 1, DAY - 1, DAY)] + [-5]
    rows = [
        (i, chance.choice(["backup", "user", None]), chance.choice([None, 0, 5, 7]), chance.choice(times), chance.choice(times))
        for i in range(600)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def report(spark, files, logs, sums):
    history = [statistics.HistoryTable("log", logs, "timecreated"), statistics.HistoryTable("absent", None, "t")]
    want = statistics.usage_statistics(spark, files, COMPONENTS, history, AS_OF)
    got = rollup.usage_statistics_from(sums, COMPONENTS, ["log", "absent"], ["log"], AS_OF)
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    every = rollup.file_stats_from(sums.partials(), None, AS_OF)
    assert rows_of(every.where("n_files > 0")) == rows_of(statistics.file_stats(files, None, AS_OF).where("n_files > 0"))


def test_batches_deletions_replays_and_merges(spark, files, tmp_path):
    sums = rollup.Rollup(spark, str(tmp_path / "sums"))
    assert sums.partials().count() == 0
    logs = files.select("id", "timecreated")
    for k in range(3):
        sums.add(f"files-{k}", rollup.file_partials(files.where(f"id % 3 = {k}")))
    sums.add("logs", rollup.history_partials("log", logs, "timecreated"))
    report(spark, files, logs, sums)
    sums.compact()
    sums.add("files-1", rollup.file_partials(files.where("id % 3 = 1")))  # a replay of a merged batch
    gone = files.where("id % 5 = 0")
    for _ in range(2):  # and of one that is not merged yet
        sums.add("gone", rollup.file_partials(gone, gone=True), rollup.history_partials("log", logs.where("id < 50"), "timecreated", gone=True))
    left, left_logs = files.where("id % 5 <> 0"), logs.where("id >= 50")
    report(spark, left, left_logs, sums)
    sums.compact()
    sums.add("gone", rollup.file_partials(gone, gone=True))
    report(spark, left, left_logs, sums)


def test_an_unfinished_merge_counts_for_nothing(spark, files, tmp_path):
    folder = tmp_path / "sums"
    sums = rollup.Rollup(spark, str(folder))
    sums.add("one", rollup.file_partials(files))
    before = rows_of(sums.partials())
    sums.partials().write.parquet(str(folder / "merged-1" / "rows"))  # the names were not written
    assert rows_of(sums.partials()) == before
    sums.compact()
    assert rows_of(sums.partials()) == before
    assert rows_of(sums.partials()) == rows_of(rollup.merged(rollup.file_partials(files)))


def test_what_comes_and_goes_leaves_nothing(spark, files, tmp_path):
    sums = rollup.Rollup(spark, str(tmp_path / "sums"))
    sums.add("in", rollup.file_partials(files))
    sums.add("out", rollup.file_partials(files, gone=True))
    assert sums.partials().count() == 0


def test_bad_names_and_moments(spark, files, tmp_path):
    sums = rollup.Rollup(spark, str(tmp_path / "sums"))
    with pytest.raises(ValueError):
        sums.add("../other", rollup.file_partials(files))
    with pytest.raises(ValueError):
        rollup.file_stats_from(sums.partials(), None, AS_OF + 1)


def test_the_report_reads_no_rows(spark, files, tmp_path):
    """What is scanned is the folder of sums."""
    place = str(tmp_path / "files")
    files.write.parquet(place)
    sums = rollup.Rollup(spark, str(tmp_path / "sums"))
    sums.add("one", rollup.file_partials(spark.read.parquet(place)))
    plan = rollup.file_stats_from(sums.partials(), COMPONENTS, AS_OF)
    read = plan.inputFiles()
    assert read and all("/sums/batches/one/" in file for file in read)
