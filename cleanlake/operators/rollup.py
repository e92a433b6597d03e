"""The usage report from partial sums instead of rows.

Partial sums per day and component or table can be added up: rows that arrive add a batch of them,
rows that go add one below zero. A batch is written once under its name, so doing it again
changes nothing, and batches are merged from time to time. The report then costs as much as there are
days and components, however many rows there are.

A period begins or ends with a day, but one of them leaves out its very first second. So what lies
on the first second of a day is counted apart.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.functions.clock import years_before
from cleanlake.functions.predicates import file_time
from cleanlake.operators.statistics import file_lines, history_lines, report_lines, skipped_lines
from cleanlake.policy import DAY
from cleanlake.sources.tables import path_exists

SCHEMA = "section string, item string, day bigint, at_start boolean, n bigint, n_bytes bigint"
FILES, HISTORY = "files", "history"
_KEY = ("section", "item", "day", "at_start")


def _partials(rows: DataFrame, section: str, item, ts, size, gone: bool) -> DataFrame:
    sign = F.lit(-1 if gone else 1)
    day = F.floor(ts / F.lit(DAY)).cast("bigint")
    return rows.groupBy(
        F.lit(section).alias("section"), item.alias("item"), day.alias("day"), (ts % F.lit(DAY) == 0).alias("at_start")
    ).agg(
        (F.count(F.lit(1)) * sign).alias("n"),
        (F.coalesce(F.sum(size), F.lit(0)) * sign).cast("bigint").alias("n_bytes"),
    )


def file_partials(files: DataFrame, gone: bool = False) -> DataFrame:
    """Partial sums of file records that arrive, or that are ``gone``."""
    return _partials(files, FILES, F.col("component"), file_time(), F.col("filesize"), gone)


def history_partials(name: str, rows: DataFrame, ts: str, gone: bool = False) -> DataFrame:
    """Partial sums of rows of a history table, which has no bytes of its own."""
    return _partials(rows, HISTORY, F.lit(name), F.col(ts), F.lit(0), gone)


def merged(partials: DataFrame) -> DataFrame:
    """One row per key. What arrived and has all gone leaves nothing."""
    sums = partials.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    return sums.where((F.col("n") != 0) | (F.col("n_bytes") != 0))


class Rollup:
    """Partial sums in a folder of their own: ``batches/<name>``, and merged ones in ``merged-<k>``.

    A merged table lists the batches that it holds beside it, written last, so a merge that was
    broken off counts for nothing and a batch never counts twice.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def _list(self, path: str) -> list[str]:
        if not path_exists(self.spark, path):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(hadoop)
        return sorted(f.getPath().getName() for f in found if f.isDirectory())

    def _complete(self, path: str) -> bool:
        return path_exists(self.spark, f"{path}/_SUCCESS")

    def _generation(self) -> tuple[int, list[str]]:
        """The newest merged table and the batches that it holds; 0 if there is none."""
        numbers = [int(n.rpartition("-")[2]) for n in self._list(self.location) if re.fullmatch(r"merged-\d+", n)]
        for k in sorted(numbers, reverse=True):
            names = f"{self.location}/merged-{k}/names"
            if self._complete(names):
                rows = self.spark.read.schema("name string").parquet(names).collect()
                return k, [r["name"] for r in rows]
        return 0, []

    def _open(self, held: Sequence[str]) -> list[str]:
        found = self._list(f"{self.location}/batches")
        return [n for n in found if n not in set(held) and self._complete(f"{self.location}/batches/{n}")]

    def add(self, name: str, *partials: DataFrame) -> None:
        """Add a batch; one of this name that is there already is the same batch."""
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith((".", "_")):
            raise ValueError("a batch is named by letters, digits, points, lines and dashes")
        path = f"{self.location}/batches/{name}"
        _, held = self._generation()
        if name in held or self._complete(path):
            return
        rows = partials[0]
        for more in partials[1:]:
            rows = rows.unionByName(more)
        merged(rows).coalesce(1).write.mode("overwrite").parquet(path)

    def partials(self) -> DataFrame:
        """All partial sums as they are now."""
        k, held = self._generation()
        paths = [f"{self.location}/batches/{n}" for n in self._open(held)]
        if k:
            paths.append(f"{self.location}/merged-{k}/rows")
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return merged(self.spark.read.schema(SCHEMA).parquet(*paths))

    def compact(self) -> None:
        """Merge all batches so far into one table. Older files stay; nothing reads them any more."""
        k, held = self._generation()
        names = [*held, *self._open(held)]
        folder = f"{self.location}/merged-{k + 1}"
        self.partials().write.mode("overwrite").parquet(f"{folder}/rows")
        frame = self.spark.createDataFrame([(n,) for n in names], "name string")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/names")


def _bounds(as_of: int) -> tuple[int, int]:
    one, two = years_before(as_of, 1), years_before(as_of, 2)
    if one % DAY or two % DAY:
        raise ValueError("a report from days is for the beginning of a day (UTC)")
    return one // DAY, two // DAY


def file_stats_from(partials: DataFrame, components: Sequence[str] | None, as_of: int) -> DataFrame:
    """``statistics.file_stats`` from partial sums; ``as_of`` is the beginning of a day."""
    one, two = _bounds(as_of)
    rows = partials.where(F.col("section") == FILES).withColumnRenamed("item", "component")
    if components is not None:
        rows = rows.where(F.col("component").isin(*components))
    day = F.col("day")
    after = (day > one) | ((day == one) & ~F.col("at_start"))
    conditions = (F.lit(True), after, (day >= two) & (day < one))
    sums = rows.groupBy("component").agg(
        *[F.sum(F.when(c, F.col("n"))).alias(f"n_{i}") for i, c in enumerate(conditions)],
        *[F.sum(F.when(c, F.col("n_bytes"))).alias(f"b_{i}") for i, c in enumerate(conditions)],
    )
    return file_lines(sums, components)


def history_stats_from(partials: DataFrame, names: Sequence[str], known: Sequence[str], as_of: int) -> DataFrame:
    """``statistics.history_stats`` from partial sums; tables that are not ``known`` are skipped."""
    one, two = _bounds(as_of)
    day, n = F.col("day"), F.col("n")
    parts = None
    for name in names:
        if name in known:
            rows = partials.where((F.col("section") == HISTORY) & (F.col("item") == name))
            conditions = (F.lit(True), day >= one, (day >= two) & (day < one))
            zero = F.lit(0).cast("bigint")
            counts = rows.agg(
                *[F.coalesce(F.sum(F.when(c, n)), zero).alias(f"n_{i}") for i, c in enumerate(conditions)]
            )
            part = history_lines(counts, name)
        else:
            part = skipped_lines(partials.sparkSession, name)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def usage_statistics_from(
    rollup: Rollup, components: Sequence[str], names: Sequence[str], known: Sequence[str], as_of: int
) -> DataFrame:
    """``statistics.usage_statistics`` without reading a row of the tables."""
    partials = rollup.partials()
    return report_lines(
        file_stats_from(partials, components, as_of), history_stats_from(partials, names, known, as_of), as_of
    )
