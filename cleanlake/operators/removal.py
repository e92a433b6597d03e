"""Removing chosen files, and taking content off the storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.functions.formats import mib
from cleanlake.operators.orphans import unwritten
from cleanlake.sources.inventory import file_tasks, open_root

REMOVED, ABSENT, ERROR, PLANNED = "removed", "absent", "error", "planned"


def remove_by_file(
    files: DataFrame,
    chosen: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """Every record that shares its content with one of the chosen ids.

    ``keep`` may write the contents; one with very many records is split then.
    """
    contents = (
        files.select("id", "contenthash")
        .join(chosen.select("id"), "id", "left_semi")
        .select("contenthash")
        .distinct()
    )
    contents = keep(contents, "chosen-contents")
    return files.join(contents, "contenthash", "left_semi").select(*files.columns)


def removal_summary(
    files: DataFrame,
    inventory: DataFrame,
    chosen: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """One row per chosen id: what its removal means.

    ``status`` is ``not_found`` for an unknown id, ``record_only`` when the content is not
    stored, else ``content``. ``n_records`` counts all records that go with it. The chosen records
    are looked at twice; ``keep`` may write them, so that they are found once.
    """
    picked = chosen.select("id").distinct()
    wanted = files.join(picked, "id", "left_semi").select(
        "id", "contenthash", "filename", "filesize"
    )
    wanted = keep(wanted, "chosen-records")
    # The chosen contents are few as a rule: a broadcast leaves only their records to count.
    shared = (
        files.select("contenthash")
        .join(wanted.select("contenthash"), "contenthash", "left_semi")
        .groupBy("contenthash")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
    stored = inventory.select("contenthash").distinct().withColumn("present", F.lit(True))
    state = shared.join(stored, "contenthash", "left")
    found = wanted.join(state, "contenthash")
    status = (
        F.when(F.col("n_records").isNull(), "not_found")
        .when(F.col("present"), "content")
        .otherwise("record_only")
    )
    return picked.join(found, "id", "left").select(
        "id",
        F.col("filename").alias("name"),
        mib("filesize", None).alias("size_mib"),
        mib("filesize", 2).alias("size_shown"),
        F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records"),
        status.alias("status"),
    )


def removable_records(doomed: DataFrame, unlinked: DataFrame) -> DataFrame:
    """Doomed records without those whose content could not be taken off the storage.

    ``unlinked`` has ``(contenthash, status)``. Content that was already absent is fine.
    """
    failed = unlinked.where(F.col("status") == ERROR).select("contenthash").distinct()
    return doomed.join(failed, "contenthash", "left_anti").select(*doomed.columns)


def unlink_files(
    paths: DataFrame, root: str, dry_run: bool = True, parallelism: int | None = None
) -> DataFrame:
    """``(path, status)`` per distinct path, deleting the files unless ``dry_run``.

    Deleting is done where the task runs. A task that is run again finds the files gone
    and reports them absent, which callers treat like removed. The result is lazy: write it once
    and read it back rather than evaluating it twice.
    """
    distinct = paths.select("path").distinct()
    if dry_run:
        return distinct.withColumn("status", F.lit(PLANNED))

    def unlink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_root(root)

        def remove(path: str) -> str:
            try:
                filesystem.delete_file(f"{base}/{path}")
                return REMOVED
            except FileNotFoundError:
                return ABSENT
            except OSError:
                return ERROR

        for frame in frames:
            yield frame.assign(status=[remove(p) for p in frame["path"]])

    tasks = parallelism or file_tasks(paths.sparkSession)
    return distinct.repartition(tasks, "path").mapInPandas(unlink, "path string, status string")
