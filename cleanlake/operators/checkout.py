"""Check-out of file records against stored content.

Records are thought of as visited by ascending id. A record goes when its content is
missing, when it is an outdated backup, or when it is an outdated draft that is the only
record of its content; the latter two also remove the content, after which every later record
of that content is "missing" too. The outcome has a closed form per content:

====================================================  ==============  =======
record (first line that holds)                        action          content
====================================================  ==============  =======
content not stored                                    missing         -
id above the lowest outdated backup of the content    content_gone    -
it is that lowest outdated backup                     backup          unlink
outdated draft and only record of the content         draft           unlink
anything else                                         keep            -
====================================================  ==============  =======

So a content loses its file although records with lower ids than its first outdated
backup are kept; those are found missing by the next run. ``safe_shared_content`` avoids
this: outdated backups then go as records only, and the content is unlinked when
all its records are outdated backups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.functions.predicates import is_backup_name, is_draft, older_than
from cleanlake.operators.orphans import unwritten
from cleanlake.policy import RetentionPolicy

KEEP, MISSING, GONE, BACKUP, DRAFT = "keep", "missing", "content_gone", "backup", "draft"


def with_presence(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``present``: whether the content of the record is stored."""
    stored = inventory.select("contenthash").distinct().withColumn("present", F.lit(True))
    joined = files.join(stored, "contenthash", "left")
    return joined.select(
        *files.columns, F.coalesce("present", F.lit(False)).alias("present")
    )


def _outdated_backup(policy: RetentionPolicy, as_of: int):
    cutoff = policy.cutoff(as_of, policy.backup_days)
    return is_backup_name() & older_than("timecreated", cutoff, inclusive=True)


def _outdated_draft(policy: RetentionPolicy, as_of: int):
    cutoff = policy.cutoff(as_of, policy.draft_days)
    return is_draft() & older_than("timecreated", cutoff, inclusive=True)


def content_state(
    files: DataFrame, inventory: DataFrame, policy: RetentionPolicy, as_of: int
) -> DataFrame:
    """One row per content that has records.

    ``n`` records, ``n_backups`` outdated backups, ``first_backup`` the lowest id among them,
    ``draft`` the id of an outdated draft, and ``present``. Records and listing go through one
    aggregate rather than an aggregate each and a join. It has a map-side part, so a content with
    very many records costs one row per map task.
    """
    records = files.select(
        "contenthash",
        "id",
        _outdated_backup(policy, as_of).alias("backup"),
        _outdated_draft(policy, as_of).alias("draft"),
        F.lit(False).alias("stored"),
    )
    listed = inventory.select(
        "contenthash",
        F.lit(None).cast(files.schema["id"].dataType).alias("id"),
        F.lit(False).alias("backup"),
        F.lit(False).alias("draft"),
        F.lit(True).alias("stored"),
    )
    return (
        records.unionByName(listed)
        .groupBy("contenthash")
        .agg(
            F.count("id").alias("n"),
            F.count(F.when(F.col("backup"), 1)).alias("n_backups"),
            F.min(F.when(F.col("backup"), F.col("id"))).alias("first_backup"),
            F.max(F.when(F.col("draft"), F.col("id"))).alias("draft"),
            F.max("stored").alias("present"),
        )
        .where(F.col("n") > 0)
    )


def _lone_draft():
    return F.col("present") & F.col("first_backup").isNull() & (F.col("n") == 1)


def _action(safe_shared_content: bool):
    first = F.col("first_backup")
    action = F.when(~F.col("present"), MISSING)
    if safe_shared_content:
        action = action.when(F.col("outdated"), BACKUP)
    else:
        action = action.when(F.col("id") > first, GONE).when(F.col("id") == first, BACKUP)
    return action.when((F.col("id") == F.col("draft")) & _lone_draft(), DRAFT).otherwise(KEEP)


def _records(files: DataFrame, policy: RetentionPolicy, as_of: int) -> DataFrame:
    return files.select(
        "id",
        "contenthash",
        F.col("filesize").alias("bytes"),
        _outdated_backup(policy, as_of).alias("outdated"),
    )


def files_checkout(
    files: DataFrame,
    inventory: DataFrame,
    policy: RetentionPolicy,
    as_of: int,
    safe_shared_content: bool = False,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """``(id, contenthash, action)`` for every record.

    ``keep`` may write the state of the contents; a content with very many records is split then.
    """
    state = keep(content_state(files, inventory, policy, as_of), "content-state")
    records = _records(files, policy, as_of)
    joined = records.join(state, "contenthash", "left")
    return joined.select("id", "contenthash", _action(safe_shared_content).alias("action"))


def checkout_doomed(
    files: DataFrame,
    inventory: DataFrame,
    policy: RetentionPolicy,
    as_of: int,
    safe_shared_content: bool = False,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """``(id, contenthash, action, bytes)`` for the records that go.

    Only contents that lose records are joined back to the records, as a rule a small part.
    ``keep`` may write them; a content with very many records is split then.
    """
    loses = (
        ~F.col("present")
        | F.col("first_backup").isNotNull()
        | (_lone_draft() & F.col("draft").isNotNull())
    )
    state = keep(content_state(files, inventory, policy, as_of).where(loses), "losing-contents")
    records = _records(files, policy, as_of)
    joined = records.join(state, "contenthash")
    action = _action(safe_shared_content)
    return joined.select("id", "contenthash", action.alias("action"), "bytes").where(
        F.col("action") != KEEP
    )


def unlink_hashes(
    files: DataFrame,
    inventory: DataFrame,
    policy: RetentionPolicy,
    as_of: int,
    safe_shared_content: bool = False,
) -> DataFrame:
    """``(contenthash, reason)`` of contents the check-out takes off the storage."""
    state = content_state(files, inventory, policy, as_of).where("present")
    gone = F.col("n_backups") == F.col("n") if safe_shared_content else F.lit(True)
    backup = F.col("first_backup").isNotNull() & gone
    reason = F.when(backup, BACKUP).when(_lone_draft() & F.col("draft").isNotNull(), DRAFT)
    return state.select("contenthash", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )
