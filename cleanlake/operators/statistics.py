"""Counts and bytes per component, per history table and per period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.functions.clock import years_before
from cleanlake.functions.formats import day, format_bytes
from cleanlake.functions.predicates import file_time, time_range
from cleanlake.sources.tables import BYTES_PER_ROW_GUESS, table_bytes

PERIODS = ("all", "last_year", "year_before")

# History tables in the order they are reported, and their time column.
HISTORY_TABLES = (
    ("logstore_standard_log", "timecreated"),
    ("logstore_lanalytics_log", "timecreated"),
    ("grade_grades_history", "timemodified"),
    ("grade_items_history", "timemodified"),
)


def _if(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def component_stats(
    files: DataFrame,
    component: str,
    until: int | None = None,
    newer: bool = False,
    since: int | None = None,
) -> DataFrame:
    """One row: files and bytes of a component, over a period when one is given."""
    found = files.where(F.col("component") == component)
    ts = F.col("timemodified" if component == "backup" else "timecreated")
    period = time_range(ts, until, newer, since)
    if period is not None:
        found = found.where(period)
    return found.agg(
        F.count("id").alias("n_files"),
        F.coalesce(F.sum("filesize"), F.lit(0)).alias("n_bytes"),
    )


def file_stats(files: DataFrame, components: Sequence[str] | None, as_of: int) -> DataFrame:
    """``(component, period, n_files, n_bytes)`` for all periods in one pass over files.

    ``last_year`` is strictly after one year ago; ``year_before`` runs from two years ago
    up to, but without, one year ago. Components without files are listed with zeros;
    ``components=None`` reports every component there is.
    """
    one, two = years_before(as_of, 1), years_before(as_of, 2)
    ts = file_time()
    conditions = (
        None,
        time_range(ts, until=one, newer=True),
        time_range(ts, since=two, until=one),
    )
    if components is not None:
        files = files.where(F.col("component").isin(*components))
    sums = files.groupBy("component").agg(
        *[F.count(_if(c, F.lit(1))).alias(f"n_{i}") for i, c in enumerate(conditions)],
        *[F.sum(_if(c, F.col("filesize"))).alias(f"b_{i}") for i, c in enumerate(conditions)],
    )
    return file_lines(sums, components)


def file_lines(sums: DataFrame, components: Sequence[str] | None) -> DataFrame:
    """A row per component and period from one per component, with counts ``n_i`` and bytes ``b_i``."""
    if components is not None:
        wanted = sums.sparkSession.createDataFrame([(c,) for c in components], "component string")
        sums = wanted.join(sums, "component", "left")
    zero = F.lit(0).cast("bigint")
    lines = [
        F.struct(
            F.lit(period).alias("period"),
            F.coalesce(f"n_{i}", zero).alias("n_files"),
            F.coalesce(f"b_{i}", zero).alias("n_bytes"),
        )
        for i, period in enumerate(PERIODS)
    ]
    return sums.select("component", F.inline(F.array(*lines)))


@dataclass(frozen=True)
class HistoryTable:
    """A table with its time column and, when known, the bytes it takes."""

    name: str
    rows: DataFrame | None
    ts: str
    size: int | None = None


def history_stats(spark: SparkSession, tables: Sequence[HistoryTable], as_of: int) -> DataFrame:
    """``(table, period, n_rows, n_bytes, status)``, one pass over each table's time column.

    Bytes of a period are the table's bytes times its share of the rows. Without a known
    size a row counts as 1 KiB. Tables that do not exist are reported as skipped.
    """
    one, two = years_before(as_of, 1), years_before(as_of, 2)
    parts = [_table_stats(spark, t, one, two) for t in tables]
    return reduce(DataFrame.unionByName, parts)


def _table_stats(spark: SparkSession, table: HistoryTable, one: int, two: int) -> DataFrame:
    if table.rows is None:
        return skipped_lines(spark, table.name)
    ts = F.col(table.ts)
    counts = table.rows.agg(
        F.count(F.lit(1)).alias("n_0"),
        F.count(F.when(ts >= F.lit(one), 1)).alias("n_1"),
        F.count(F.when((ts >= F.lit(two)) & (ts < F.lit(one)), 1)).alias("n_2"),
    )
    return history_lines(counts, table.name, table.size)


def skipped_lines(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(
        [(name, None, None, None, "skipped")],
        "table string, period string, n_rows bigint, n_bytes double, status string",
    )


def history_lines(counts: DataFrame, name: str, bytes_known: int | None = None) -> DataFrame:
    """A row per period of one history table from its counts ``n_i``."""
    total = F.col("n_0").cast("double")
    size = total * BYTES_PER_ROW_GUESS if bytes_known is None else F.lit(float(bytes_known))
    lines = []
    for i, period in enumerate(PERIODS):
        share = F.col(f"n_{i}").cast("double") / total
        lines.append(
            F.struct(
                F.lit(period).alias("period"),
                F.col(f"n_{i}").alias("n_rows"),
                (size if i == 0 else F.when(total > 0, size * share).otherwise(F.lit(0.0))).alias(
                    "n_bytes"
                ),
            )
        )
    return counts.select(
        F.lit(name).alias("table"),
        F.inline(F.array(*lines)),
    ).withColumn("status", F.lit("ok"))


def period_days(period: Column, as_of: int) -> tuple[Column, Column]:
    """First and last day a period is shown with; ``all`` has no first day."""
    one, two = F.lit(years_before(as_of, 1)), F.lit(years_before(as_of, 2))
    since = F.when(period == "last_year", one).when(period == "year_before", two)
    until = F.when(period == "year_before", one).when(period.isNotNull(), F.lit(as_of))
    return day(since), day(until)


def usage_statistics(
    spark: SparkSession,
    files: DataFrame,
    components: Sequence[str],
    history: Sequence[HistoryTable],
    as_of: int,
    paths: Mapping[str, str] | None = None,
) -> DataFrame:
    """The whole usage report.

    ``(section, item, period, since, until, n, n_bytes, shown, status)``. ``paths`` says where
    history tables lie whose size is not given; their files' sizes are summed then.
    """
    sizes = {
        name: table_bytes(spark, path).first()["bytes"] for name, path in (paths or {}).items()
    }
    history = [
        t if t.size is not None else replace(t, size=sizes.get(t.name)) for t in history
    ]
    return report_lines(
        file_stats(files, components, as_of), history_stats(spark, history, as_of), as_of
    )


def report_lines(of_files: DataFrame, of_history: DataFrame, as_of: int) -> DataFrame:
    """The report from the statistics of files and of history tables."""
    of_files = of_files.select(
        F.lit("files").alias("section"),
        F.col("component").alias("item"),
        "period",
        F.col("n_files").alias("n"),
        F.col("n_bytes").cast("double").alias("n_bytes"),
        F.lit("ok").alias("status"),
    )
    of_history = of_history.select(
        F.lit("history").alias("section"),
        F.col("table").alias("item"),
        "period",
        F.col("n_rows").alias("n"),
        "n_bytes",
        "status",
    )
    both = of_files.unionByName(of_history)
    shown = F.when(F.col("n_bytes").isNotNull(), format_bytes("n_bytes"))
    since, until = period_days(F.col("period"), as_of)
    return both.withColumns({"shown": shown, "since": since, "until": until})
