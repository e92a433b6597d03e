"""Remove chosen files: their content, and every record that shares it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.operators import removal
from cleanlake.operators.orphans import survivors
from cleanlake.plans.staging import Staging
from cleanlake.sources.inventory import with_content_key


def run_removal(
    spark: SparkSession,
    files: DataFrame,
    inventory: DataFrame,
    chosen: DataFrame,
    target: str,
    root: str | None = None,
    dry_run: bool = True,
) -> dict[str, DataFrame]:
    """The new file records, what each chosen id meant, and the fate of each stored file.

    Content is unlinked first; records of content that could not be unlinked stay. Records of
    content that is not stored go as well. A dry run writes what would happen, and no new table.
    """
    dry_run = dry_run or root is None
    staging = Staging(spark, target)
    with Staging(spark) as scratch:
        records = removal.remove_by_file(files.select("id", "contenthash"), chosen, scratch.keep)
        doomed = staging.keep(records, "doomed-files")
        summary = removal.removal_summary(files, inventory, chosen, scratch.keep)
        summary = staging.keep(summary, "summary")
    contents = doomed.select("contenthash").distinct()
    paths = inventory.join(contents, "contenthash", "left_semi").select("path")
    unlinked = removal.unlink_files(paths, root or "", dry_run=dry_run)
    unlinked = staging.keep(unlinked, "unlinked")
    if dry_run:
        return {"summary": summary, "unlinked": unlinked}
    failed = unlinked.where(F.col("status") == removal.ERROR)
    gone = removal.removable_records(doomed, with_content_key(failed))
    return {
        "files": staging.keep(survivors(files, gone), "table-files"),
        "summary": summary,
        "unlinked": unlinked,
    }
