"""Retention by whole files: what footers prove to be past its time is dropped unread.

A file is aged when its latest time lies before the cut-off and no time is null, fresh when its earliest
does not, and mixed otherwise, or when its footer does not say. Only mixed files are filtered row by row.
The files of a folder may be judged together, as one: then none of them has to hold the whole folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cleanlake.functions.predicates import holds, older_than
from cleanlake.operators.orphans import orphans
from cleanlake.operators.vectors import read_files
from cleanlake.plans.staging import Staging
from cleanlake.sources.footers import FILE, file_footers

AGED, FRESH, MIXED = "aged", "fresh", "mixed"


def _by_folder(footers: DataFrame) -> DataFrame:
    """Footers of the files of a folder as one; bounds that one of them does not say are not known."""
    silent = F.col("low").isNull() & ~F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False))
    told = F.count(F.when(silent, 1)) == 0
    return footers.groupBy(F.regexp_replace(FILE, "/[^/]*$", "").alias(FILE)).agg(
        F.sum("rows").alias("rows"),
        F.when(F.count("nulls") == F.count(F.lit(1)), F.sum("nulls")).alias("nulls"),
        F.when(told, F.min("low")).alias("low"),
        F.when(told, F.max("high")).alias("high"),
    )


def files_by_age(
    spark: SparkSession, location: str, ts: str, cutoff: int, by_folder: bool = False
) -> DataFrame:
    """(``_file``, ``rows``, ``nulls``, ``low``, ``high``, ``verdict``) from footers alone.

    With ``by_folder`` there is one row per folder, and ``_file`` names the folder.
    """
    known = F.col("low").isNotNull()
    verdict = (
        F.when(F.col("rows") == 0, FRESH)
        .when(known & (F.col("high") < cutoff) & (F.col("nulls") == 0), AGED)
        .when(known & (F.col("low") >= cutoff), FRESH)
        .when(F.col("nulls") == F.col("rows"), FRESH)
        .otherwise(MIXED)
    )
    footers = file_footers(spark, location, ts)
    return (_by_folder(footers) if by_folder else footers).withColumn("verdict", verdict)


@dataclass(frozen=True)
class AgedTable:
    """The files of a table by age, listed once and kept as a table."""

    location: str
    schema: StructType
    ts: str
    cutoff: int
    listed: DataFrame

    def files(self, verdict: str) -> list[str]:
        """As many names as the planner lists for a scan anyway."""
        found = self.listed.where(F.col("verdict") == verdict).select(FILE)
        return sorted(r[0] for r in found.collect())

    def _rows(self, verdict: str) -> DataFrame:
        spark = self.listed.sparkSession
        return read_files(spark, self.location, self.schema, self.files(verdict))

    def kept(self) -> DataFrame:
        """Rows that are not older than the cut-off; a null time is not."""
        young = self._rows(MIXED).where(~holds(older_than(self.ts, self.cutoff)))
        return self._rows(FRESH).unionByName(young)

    def kept_with_parent(self, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
        """Those of them that have a parent: what the rule "orphan or aged" spares."""
        return self.kept().join(parent.select(F.col(pk).alias(fk)), fk, "left_semi")

    def doomed(self, parent: DataFrame | None = None, fk: str | None = None) -> DataFrame:
        """Doomed rows of files that live on, with the ``reason``; aged files go as a whole."""
        old = self._rows(MIXED).where(older_than(self.ts, self.cutoff)).withColumn("reason", F.lit("aged"))
        if parent is None or fk is None:
            return old
        lost = orphans(self.kept(), parent, fk)
        return old.unionByName(lost.withColumn("reason", F.lit("orphan")))

    def summary(self) -> DataFrame:
        """(``verdict``, ``files``, ``rows``)."""
        return self.listed.groupBy("verdict").agg(
            F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")
        )


def aged_table(
    spark: SparkSession,
    location: str,
    schema: StructType | str,
    ts: str,
    cutoff: int,
    staging: Staging,
    by_folder: bool = False,
) -> AgedTable:
    rows = read_files(spark, location, schema)
    listed = staging.keep(files_by_age(spark, location, ts, cutoff, by_folder), "files-by-age")
    return AgedTable(location, rows.schema, ts, cutoff, listed)
