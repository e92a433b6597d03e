"""What Parquet footers say about each file of a table, read where the tasks run.

A footer has the number of rows and, per row group, bounds and nulls of each column. So a question such
as "which files are older than that" costs one small read per file and none of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.sources.inventory import file_tasks

FILE = "_file"


def data_files(spark: SparkSession, location: str) -> DataFrame:
    """(``_file``, ``length``) of the Parquet files at or below ``location``. Only the listing is read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(location)
    )
    return listing.select(F.col("_metadata.file_path").alias(FILE), "length")


def _seconds(value) -> int | None:
    """A bound as a whole number: numbers as they are, times as seconds, rounded down."""
    if isinstance(value, bool) or isinstance(value, int):
        return int(value)
    if isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return int(moment.timestamp() // 1)
    if isinstance(value, date):
        return int(datetime(value.year, value.month, value.day, tzinfo=timezone.utc).timestamp())
    return None


def _bounds(metadata, column: str) -> tuple[int | None, int | None, int | None]:
    """Lowest and highest value and number of nulls over all row groups; None where a row group
    does not say."""
    names = [metadata.schema.column(i).path for i in range(metadata.num_columns)]
    if column not in names:
        return None, None, None
    lows, highs, nulls = [], [], 0
    for group in range(metadata.num_row_groups):
        chunk = metadata.row_group(group).column(names.index(column))
        found = chunk.statistics
        if found is None or not found.has_null_count:
            return None, None, None
        nulls += found.null_count
        if found.null_count == chunk.num_values:
            continue
        low, high = (_seconds(v) for v in (found.min, found.max)) if found.has_min_max else (None, None)
        if low is None or high is None:
            return None, None, nulls
        lows.append(low)
        highs.append(high)
    return (min(lows), max(highs), nulls) if lows else (None, None, nulls)


def file_footers(
    spark: SparkSession, location: str, column: str, parallelism: int | None = None
) -> DataFrame:
    """(``_file``, ``rows``, ``nulls``, ``low``, ``high``), one row per file.

    ``low`` and ``high`` are bounds of a whole-number or time column, both null when the file has no value
    or does not say; ``nulls`` is null when it does not say. A file each is little work that waits on
    storage, so the spread is set by number of tasks.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs, parquet

        for frame in frames:
            found = []
            for file in frame[FILE]:
                # Spark writes local paths with one slash or with three.
                filesystem, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                with filesystem.open_input_file(path) as stream:
                    metadata = parquet.read_metadata(stream)
                low, high, nulls = _bounds(metadata, column)
                found.append((file, metadata.num_rows, nulls, low, high))
            out = pd.DataFrame(found, columns=[FILE, "rows", "nulls", "low", "high"], dtype=object)
            yield out

    files = data_files(spark, location).select(FILE).repartition(parallelism or file_tasks(spark), FILE)
    return files.mapInPandas(read, f"{FILE} string, rows bigint, nulls bigint, low bigint, high bigint")
