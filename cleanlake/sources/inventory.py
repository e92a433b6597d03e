"""Distributed listing of a content-addressed storage tree.

The driver never sees the file list. It ships the root to the executors, which list
one directory level per step and hand the sub-directories on to the next step, spread
over the cluster by path. The last step walks whatever lies deeper. A storage tree with
two levels of fan-out is thus listed by as many tasks as there are leaf directories,
up to ``parallelism``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.functions.formats import base_name

_ENTRY = "path string, is_dir boolean, length bigint"
_BATCH = 10_000


def open_root(root: str):
    """Filesystem and base path of a root given as a URI or a local path."""
    from pyarrow import fs

    filesystem, base = fs.FileSystem.from_uri(root)
    return filesystem, base.rstrip("/")


def file_tasks(spark: SparkSession) -> int:
    """Number of tasks for work that waits on storage rather than on data."""
    return 4 * spark.sparkContext.defaultParallelism


def _children(filesystem, base: str, path: str):
    """Entries of one directory, names with a leading dot left out.

    A local (or mounted) directory is read entry by entry. Object stores have no directories as such;
    their client returns one level as a list.
    """
    from pyarrow import fs

    folder = f"{base}/{path}"
    if isinstance(filesystem, fs.LocalFileSystem):
        try:
            listing = os.scandir(folder)
        except FileNotFoundError:
            return
        with listing:
            for entry in listing:
                if not entry.name.startswith("."):
                    is_dir = entry.is_dir()
                    yield f"{path}/{entry.name}", is_dir, 0 if is_dir else entry.stat().st_size
        return
    for info in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if not info.base_name.startswith("."):
            is_dir = info.type == fs.FileType.Directory
            yield f"{path}/{info.base_name}", is_dir, 0 if is_dir else info.size


def list_entries(
    filesystem, base: str, entries: Iterable[tuple[str, bool, int]], deep: bool, batch: int = _BATCH
) -> Iterator[list[tuple[str, bool, int]]]:
    """Files at or below the entries, in batches; without ``deep`` one level, directories too.

    No more than a batch and the open directories are held, however many files one has.
    """
    out: list[tuple[str, bool, int]] = []
    for entry in entries:
        pending = [iter([entry])]
        while pending:
            child = next(pending[-1], None)
            if child is None:
                pending.pop()
            elif child[1] and (deep or len(pending) == 1):
                pending.append(_children(filesystem, base, child[0]))
            else:
                out.append(child)
                if len(out) >= batch:
                    yield out
                    out = []
    if out:
        yield out


def _lister(root: str, deep: bool):
    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_root(root)
        for frame in frames:
            entries = frame.itertuples(index=False, name=None)
            for found in list_entries(filesystem, base, entries, deep):
                yield pd.DataFrame(found, columns=["path", "is_dir", "length"])

    return expand


def file_inventory(
    spark: SparkSession,
    root: str,
    area: str = "filedir",
    fanout_levels: int = 2,
    parallelism: int | None = None,
) -> DataFrame:
    """``path`` (relative to ``root``), ``contenthash`` (its last part) and ``length``.

    Hidden names are skipped, and a hidden directory with all below it.
    """
    tasks = parallelism or file_tasks(spark)
    entries = spark.createDataFrame([(area, True, 0)], _ENTRY)
    for _ in range(fanout_levels):
        entries = entries.mapInPandas(_lister(root, deep=False), _ENTRY).repartition(
            tasks, "path"
        )
    entries = entries.mapInPandas(_lister(root, deep=True), _ENTRY)
    return with_content_key(entries.where(~F.col("is_dir"))).select(
        "path", "contenthash", "length"
    )


def with_content_key(listing: DataFrame) -> DataFrame:
    """Adds the content hash a stored file is named by."""
    return listing.withColumn("contenthash", base_name("path"))
