"""The registry of ghosts as a table of buckets, of which a scan writes only those that change.

A row lies in the bucket of its path's hash, a folder each. A scan is compared with the registry
by path. Buckets in which a row is new or differs are written anew, all others keep their files, so
a scan that finds little new writes little, however large the registry is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.operators.ghosts import upsert_registry
from cleanlake.plans.staging import Staging
from cleanlake.schemas import SCHEMAS

BUCKET = "bucket"
_SCHEMA = SCHEMAS["ghost_registry"]
COLUMNS = ("id", "path", "mime", "size")


@dataclass(frozen=True)
class BucketedRegistry:
    """``location/bucket=<k>/``; ``buckets`` must be the same for the life of a registry."""

    spark: SparkSession
    location: str
    buckets: int = 4_096

    def _placed(self, rows: DataFrame, *more: str) -> DataFrame:
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        return rows.select(*COLUMNS, *more, bucket.alias(BUCKET))

    def _write(self, rows: DataFrame, mode: str) -> None:
        """One file a bucket; in mode overwrite only buckets that ``rows`` has."""
        (
            rows.repartition(BUCKET)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BUCKET)
            .parquet(self.location)
        )

    def create(self, rows: DataFrame) -> None:
        """The first version. There must be none yet."""
        self._write(self._placed(rows), "error")

    def read(self) -> DataFrame:
        return self._read().select(*COLUMNS)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(f"{_SCHEMA}, {BUCKET} int").parquet(self.location)

    def upsert(self, scan: DataFrame, staging: Staging) -> DataFrame:
        """Bring the registry up to date with a scan (``path``, ``mime``, ``size``), and return how many
        rows each ``change`` has: ``inserted``, ``updated`` (type or size differ), ``same`` and
        ``untouched`` (not met by the scan).

        Ids are given as by :func:`upsert_registry`. The buckets that change are written to ``staging``
        first and then replaced as a whole, so a scan that fails leaves the registry as it was or each
        bucket either old or new; doing it again completes it and changes nothing else.
        """
        before = staging.keep(self.read(), "registry-before")
        after = staging.keep(upsert_registry(before, scan, staging.keep), "registry-after")
        old = before.select("id", F.struct("mime", "size").alias("old"))
        judged = after.join(old, "id", "left")
        same = F.struct("mime", "size").eqNullSafe(F.col("old"))
        change = F.when((F.col("change") == "updated") & same, "same").otherwise(F.col("change"))
        judged = staging.keep(self._placed(judged.withColumn("change", change), "change"), "registry-judged")
        # At most as many rows as there are buckets.
        changed = judged.where(F.col("change").isin("inserted", "updated")).select(BUCKET).distinct()
        rows = judged.join(F.broadcast(changed), BUCKET).select(*COLUMNS, BUCKET)
        rows = staging.keep(rows, "registry-buckets")
        if not rows.isEmpty():
            self._write(rows, "overwrite")
        return judged.groupBy("change").agg(F.count(F.lit(1)).alias("rows"))

    def remove(self, paths: DataFrame, staging: Staging) -> None:
        """Take rows out again, those of unlinked files say. A bucket that is left without rows goes."""
        rows = self._read()
        hit = self._placed(rows.join(paths.select("path").distinct(), "path", "left_semi"))
        hit = staging.keep(hit.select("path", BUCKET), "registry-hit")
        touched = hit.select(BUCKET).distinct()
        left = rows.join(F.broadcast(touched), BUCKET, "left_semi").join(hit.select("path"), "path", "left_anti")
        left = staging.keep(left.select(*COLUMNS, BUCKET), "registry-left")
        empty = touched.join(left.select(BUCKET).distinct(), BUCKET, "left_anti").collect()
        if not left.isEmpty():
            self._write(left, "overwrite")
        for row in empty:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{BUCKET}={row[BUCKET]}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
