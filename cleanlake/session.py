"""Session settings the library is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Days and minutes are shown in UTC. Adaptive execution merges small partitions, splits skewed
# ones, and turns a join into a broadcast once it has seen that a side is small.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def configure(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the settings; ``shuffle_bytes`` is a guess at the largest shuffle of the job.

    It sets the number of shuffle partitions to what 128 MiB each needs, which keeps a partition
    well inside executor memory. Adaptive execution merges what turns out too small.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if shuffle_bytes:
        partitions = max(
            spark.sparkContext.defaultParallelism, -(-shuffle_bytes // (128 * 1024 * 1024))
        )
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return spark
