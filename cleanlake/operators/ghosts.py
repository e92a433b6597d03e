"""Stored content no file record points to, and the registry it is kept in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.functions.formats import gib, mib
from cleanlake.functions.mime import BINARY, sniff_stream
from cleanlake.operators.numbering import numbered
from cleanlake.operators.orphans import unwritten
from cleanlake.sources.inventory import file_tasks, open_root, with_content_key

PAGE_SIZE = 250


def scan_ghosts(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """Stored files whose content hash no record has.

    Hashes of records are reduced before the shuffle: one content may have very many
    records, and a repeated key on this side could not be split.
    """
    known = files.select("contenthash").distinct()
    return inventory.join(known, "contenthash", "left_anti").select(*inventory.columns)


def ghost_bytes(ghosts: DataFrame) -> DataFrame:
    """One row: files and bytes one scan found."""
    return ghosts.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"),
        gib(F.coalesce(F.sum("length"), F.lit(0))).alias("n_gib"),
    )


def sniff_stored(ghosts: DataFrame, root: str, parallelism: int | None = None) -> DataFrame:
    """Adds ``mime`` from the content of each stored file, read in chunks where the task runs.

    A file is read up to its first control byte, a text to its end. Meant for ghosts only, after
    the anti join. Unreadable files count as plain bytes. Rows
    are few bytes but one file access each, so their spread is set by number, not by size.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ghosts.schema)

    def read_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_root(root)

        def head_type(path: str) -> str:
            try:
                with filesystem.open_input_file(f"{base}/{path}") as stream:
                    return sniff_stream(stream.read)
            except OSError:
                return BINARY

        for frame in frames:
            yield frame.assign(mime=[head_type(p) for p in frame["path"]])

    tasks = parallelism or file_tasks(ghosts.sparkSession)
    return ghosts.repartition(tasks, "path").mapInPandas(read_heads, f"{schema}, mime string")


def registry_rows(ghosts: DataFrame) -> DataFrame:
    """Scan result in the shape the registry takes: ``(path, mime, size)``."""
    return ghosts.select("path", "mime", F.col("length").alias("size"))


def upsert_registry(
    registry: DataFrame,
    scan: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """Registry after a scan, with the ``change`` of each row.

    ``path`` is the key. Known paths keep their id and take the new type and size, new
    ones get the next ids, and paths the scan did not meet stay as they are. Both sides meet in
    one join, which is looked at several times; ``keep`` may write it.
    """
    old = registry.select(
        "path",
        F.col("id").alias("old_id"),
        F.col("mime").alias("old_mime"),
        F.col("size").alias("old_size"),
    )
    seen = scan.select("path", "mime", "size", F.lit(True).alias("seen"))
    both = keep(old.join(seen, "path", "full"), "registry-and-scan")
    known = both.where(F.col("old_id").isNotNull()).select(
        F.col("old_id").alias("id"),
        "path",
        F.coalesce("mime", "old_mime").alias("mime"),
        F.coalesce("size", "old_size").alias("size"),
        F.when(F.col("seen"), "updated").otherwise("untouched").alias("change"),
    )
    new = both.where(F.col("old_id").isNull()).select("path", "mime", "size")
    added = numbered(new, "path", registry)
    return known.unionByName(added.withColumn("change", F.lit("inserted")))


def ghost_report(
    registry: DataFrame,
    page: int = 0,
    page_size: int = PAGE_SIZE,
    after: tuple[int, str] | None = None,
) -> DataFrame:
    """A page of ghosts, largest first, ties by path.

    ``after`` is the (size, path) of the last row seen and stays cheap however far down the list it
    points; ``page`` brings all rows before the page to one task, so it is for the first pages.
    """
    if after is not None:
        size, path = after
        registry = registry.where(
            (F.col("size") < size) | ((F.col("size") == size) & (F.col("path") > path))
        )
    return (
        registry.orderBy(F.desc("size"), "path")
        .offset(page * page_size)
        .limit(page_size)
        .select("path", "mime", "size", mib("size").alias("size_mib"))
    )


def ghost_totals(registry: DataFrame) -> DataFrame:
    """One row: ghosts on record, their bytes and GiB; an empty registry has 0 bytes."""
    return registry.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"),
        gib(F.coalesce(F.sum("size"), F.lit(0))).alias("n_gib"),
    )


def registry_presence(registry: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(id, path, present)``: whether the file of each registry row is still stored."""
    stored = inventory.select("path", F.lit(True).alias("present"))
    return registry.join(stored, "path", "left").select(
        "id", "path", F.coalesce("present", F.lit(False)).alias("present")
    )


def still_unlinked(
    registry: DataFrame, files: DataFrame, doomed: DataFrame | None = None
) -> DataFrame:
    """Registry rows whose content is still without a record; those ``doomed`` do not count.

    Ghosts are few next to records, so the records are cut down to those of ghost contents
    first, before the doomed ones are dropped; as a rule that is a broadcast, and the
    records are not shuffled.
    """
    keyed = with_content_key(registry)
    linked = files.select("id", "contenthash").join(
        keyed.select("contenthash"), "contenthash", "left_semi"
    )
    if doomed is not None:
        linked = linked.join(doomed.select("id"), "id", "left_anti")
    linked = linked.select("contenthash")
    return keyed.join(linked.distinct(), "contenthash", "left_anti").select(*registry.columns)
