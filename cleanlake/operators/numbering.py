"""Ids for new rows, without ordering them all in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_DIGITS = 3
_BUCKET = "_bucket"


def numbered(new: DataFrame, key: str, in_use: DataFrame) -> DataFrame:
    """``new`` with an ``id`` each, counting on from the highest id of ``in_use``.

    ``key`` is a text that tells the new rows apart. Rows are numbered within buckets of the
    key's hash, and a bucket starts where those before it end. The numbering depends on the
    keys alone, so evaluating it again gives the same ids.
    """
    new = new.withColumn(_BUCKET, F.substring(F.md5(key), 1, _BUCKET_DIGITS))
    # At most 16 ** _BUCKET_DIGITS counts, whatever the number of rows; the highest id in use
    # is counted as a bucket that comes before all others.
    highest = in_use.select(
        F.lit("").alias(_BUCKET), F.coalesce("id", F.lit(0)).cast("bigint").alias("id")
    )
    counts = (
        highest.groupBy(_BUCKET)
        .agg(F.max("id").alias("n"))
        .unionByName(new.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n")))
    )
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        _BUCKET, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(_BUCKET).orderBy(key)
    placed = new.withColumn("_place", F.row_number().over(within))
    return (
        placed.join(F.broadcast(starts), _BUCKET)
        .withColumn("id", F.col("_start") + F.col("_place"))
        .drop(_BUCKET, "_start", "_place")
    )


def placed_in_ranges(rows: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with ``part`` (the range) and ``place`` (from 0 within it).

    Ranges are in order, and so are places, so the number of a row in the whole is its place and the
    rows of the ranges before its own. Write the result: ranges are drawn from a sample.
    """
    parts = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = [
                pa.array(np.full(batch.num_rows, part, np.int32)),
                pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64)),
            ]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "part", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(count, f"{schema}, part int, place bigint")
