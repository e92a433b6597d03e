"""The scan for unlinked files: list, compare, sniff, and bring the registry up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanlake.operators import ghosts
from cleanlake.plans.staging import Staging
from cleanlake.sources.inventory import file_inventory


def run_scan(
    spark: SparkSession,
    root: str,
    files: DataFrame,
    registry: DataFrame,
    staging: Staging | None = None,
    area: str = "filedir",
) -> tuple[DataFrame, DataFrame]:
    """The registry after the scan, and one row with what the scan found.

    The listing is written before it is used: storage changes while it is read, and all
    later parts must see the same files. Content types are read for ghosts only. What is returned
    reads from ``staging``, which the caller closes.
    """
    staging = staging or Staging(spark)
    listing = staging.keep(file_inventory(spark, root, area), "inventory")
    found = ghosts.sniff_stored(ghosts.scan_ghosts(listing, files), root)
    found = staging.keep(found, "ghosts")
    updated = ghosts.upsert_registry(registry, ghosts.registry_rows(found), staging.keep)
    return staging.keep(updated, "registry"), ghosts.ghost_bytes(found)
