"""Reading named tables, some of which may not exist."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.policy import SETTINGS, RetentionPolicy
from cleanlake.schemas import SCHEMAS

BYTES_PER_ROW_GUESS = 1024


def read_tables(
    spark: SparkSession,
    names: Iterable[str],
    location: str | None = None,
    paths: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """DataFrames for the tables that exist; absent ones are simply left out.

    Without ``location``/``paths`` the session catalog is asked. With them, parquet is read with the
    declared schema, so no file is opened to infer one.
    """
    found: dict[str, DataFrame] = {}
    for name in names:
        path = (paths or {}).get(name) or (f"{location}/{name}" if location else None)
        if path is None:
            if spark.catalog.tableExists(name):
                found[name] = spark.table(name)
        elif path_exists(spark, path):
            reader = spark.read
            if name in SCHEMAS:
                reader = reader.schema(SCHEMAS[name])
            found[name] = reader.parquet(path)
    return found


def stored_policy(settings: DataFrame) -> RetentionPolicy:
    """The policy of a table of settings (``name``, ``value``). A handful of rows come to the driver."""
    known = settings.where(F.col("name").isin(*SETTINGS)).select("name", F.col("value").cast("string").alias("value"))
    found: dict[str, str] = {}
    for row in known.distinct().collect():
        if row["name"] in found and row["value"] != found[row["name"]]:
            raise ValueError(f"setting {row['name']} has two values")
        found[row["name"]] = row["value"]
    return RetentionPolicy.from_settings(found)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def table_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes the files of a table take. Only the listing is read, no content."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
