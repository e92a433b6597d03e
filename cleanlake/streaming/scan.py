"""Ghost detection on a stream of storage notices instead of a full listing.

Any streaming frame with ``path`` and ``length`` will do: notices from an object store, or a
``binaryFile`` stream. Each micro-batch is compared with the file records as they are then,
and its ghosts are added to a table with one partition per batch; a batch that is replayed writes
its partition again. ``found_ghosts`` reads that table for ``upsert_registry``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cleanlake.operators.ghosts import scan_ghosts
from cleanlake.sources.inventory import with_content_key


def watch_storage(
    notices: DataFrame, files: Callable[[], DataFrame], target: str, checkpoint: str
) -> DataStreamWriter:
    """A stream writer to ``start``. ``files`` returns the current file records."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        stored = with_content_key(frame.select("path", "length"))
        latest = stored.groupBy("path", "contenthash").agg(F.max("length").alias("length"))
        scan_ghosts(latest, _records_of(latest, files())).write.mode("overwrite").parquet(
            f"{target}/batch={batch_id}"
        )

    return notices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _records_of(batch: DataFrame, files: DataFrame) -> DataFrame:
    """Records of the batch's contents: a batch is small, so the records are not shuffled."""
    wanted = batch.select("contenthash").distinct()
    return files.select("contenthash").join(wanted, "contenthash", "left_semi")


def found_ghosts(spark: SparkSession, target: str, files: DataFrame) -> DataFrame:
    """Latest notice per path among the ghosts found, still without a record."""
    notices = spark.read.parquet(target)
    latest = notices.groupBy("path", "contenthash").agg(
        F.max(F.struct("batch", "length")).alias("last")
    )
    return scan_ghosts(latest.select("path", "contenthash", "last.length"), files)
