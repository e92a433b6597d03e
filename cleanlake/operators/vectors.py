"""Deletes by file and row position.

A deletion vector names the doomed rows of one file by their places in it, as bitmaps over blocks
of 32,768 rows. Finding them reads the key column only. With them a table is read without its doomed
rows as it lies, and a rewrite touches no other file than those that hold doomed rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cleanlake.plans.staging import Staging
from cleanlake.sources.footers import FILE, file_footers
from cleanlake.sources.tables import path_exists

POSITION = "_position"
KEPT, MASKED, REWRITTEN, DROPPED = "kept", "masked", "rewritten", "dropped"
#: Rows that one bitmap covers; the engine's bitmap functions fix it.
BLOCK = 32_768


def read_files(
    spark: SparkSession, location: str, schema: StructType | str, files: Sequence[str] | None = None
) -> DataFrame:
    """The rows of a table, or of some of its files, with partition columns from the folders."""
    reader = spark.read.schema(schema).option("basePath", location)
    if files is None:
        return reader.parquet(location)
    if not files:
        return spark.createDataFrame([], reader.parquet(location).schema)
    return reader.parquet(*files)


def with_positions(rows: DataFrame) -> DataFrame:
    """Adds the file each row lies in and its place there. ``rows`` reads Parquet files directly."""
    return rows.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(POSITION)
    )


def _block():
    return F.expr(f"{POSITION} div {BLOCK}").alias("block")


def deletion_vectors(rows: DataFrame, doomed: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """(``_file``, ``block``, ``bits``, ``deleted``): where the rows lie whose key is in ``doomed``.

    A null key dooms nothing. A key in several rows, or twice in ``doomed``, dooms each row once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    found = with_positions(rows).select(*keys, FILE, POSITION).join(doomed.select(*keys), keys, "left_semi")
    return found.groupBy(FILE, _block()).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(POSITION) + 1)).alias("bits"),
        F.count(F.lit(1)).alias("deleted"),
    )


def vectors_where(rows: DataFrame, condition) -> DataFrame:
    """The same for rows that meet a condition; unknown does not meet it."""
    found = with_positions(rows.where(condition)).select(FILE, POSITION)
    return found.groupBy(FILE, _block()).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(POSITION) + 1)).alias("bits"),
        F.count(F.lit(1)).alias("deleted"),
    )


def merged_vectors(first: DataFrame, second: DataFrame) -> DataFrame:
    """Vectors of one table together; rows that both name count once."""
    both = first.unionByName(second).groupBy(FILE, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return both.withColumn("deleted", F.bitmap_count("bits"))


def survivors_by_position(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows that no vector names. Rows meet the vectors by file and block, 32,768 at most to a
    vector, so no file is too large for the join and nothing is looked up by key."""
    vectors = vectors.select(FILE, "block", "bits")
    placed = with_positions(rows).withColumn("block", _block())
    joined = placed.join(vectors, [FILE, "block"], "left")
    at = f"({POSITION} % {BLOCK})"
    byte = f"cast(conv(hex(substring(bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    gone = F.expr(f"shiftright({byte}, cast({at} % 8 as int)) & 1") == 1
    return joined.where(F.col("bits").isNull() | ~gone).select(*rows.columns)


@dataclass(frozen=True)
class TableVersion:
    """A table after deletes: files that are as they were, files to be read through their vectors, and
    new files with what the rewritten ones keep.

    ``manifest`` has (``_file``, ``rows``, ``deleted``, ``action``) for every old file.
    """

    location: str
    schema: StructType
    manifest: DataFrame
    vectors: DataFrame
    replacements: str

    def files(self, *actions: str) -> list[str]:
        """Old files with these actions. As many names as the planner lists for a scan anyway."""
        found = self.manifest.where(F.col("action").isin(*actions)).select(FILE)
        return sorted(r[0] for r in found.collect())

    def read(self) -> DataFrame:
        spark = self.manifest.sparkSession
        out = read_files(spark, self.location, self.schema, self.files(KEPT))
        masked = self.files(MASKED)
        if masked:
            rows = read_files(spark, self.location, self.schema, masked)
            out = out.unionByName(survivors_by_position(rows, self.vectors))
        if path_exists(spark, self.replacements):
            out = out.unionByName(read_files(spark, self.replacements, self.schema))
        return out.select(*self.schema.fieldNames())


def delete_rows(
    spark: SparkSession,
    location: str,
    schema: StructType | str,
    vectors: DataFrame,
    target: str,
    partition_by: Sequence[str] = (),
    rewrite_above: float = 0.0,
) -> TableVersion:
    """A new version of the table at ``location`` without the rows that ``vectors`` names.

    Files without doomed rows are not read but for their footers, and not written; files of which nothing
    is left are neither. Files that lose more than the share ``rewrite_above`` are written anew below
    ``target``; the others keep their vectors. Nothing at ``location`` is changed.
    """
    staging = Staging(spark, target)
    vectors = staging.keep(vectors, "vectors")
    lost = vectors.groupBy(FILE).agg(F.sum("deleted").alias("deleted"))
    rows = read_files(spark, location, schema)
    footers = file_footers(spark, location, rows.columns[0]).select(FILE, "rows")
    share = F.col("deleted") / F.col("rows")
    action = (
        F.when(F.col("deleted").isNull(), KEPT)
        .when(F.col("deleted") == F.col("rows"), DROPPED)
        .when(share > rewrite_above, REWRITTEN)
        .otherwise(MASKED)
    )
    manifest = footers.join(lost, FILE, "left").withColumn("action", action)
    manifest = manifest.withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    manifest = staging.keep(manifest, "manifest")
    version = TableVersion(location, rows.schema, manifest, vectors, f"{staging.folder}/replacements")
    touched = version.files(REWRITTEN)
    if touched:
        left = survivors_by_position(read_files(spark, location, schema, touched), vectors)
        staging.keep(left, "replacements", partition_by)
    return version
