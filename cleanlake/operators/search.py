"""Search over file records: one page of contents, counts, and display rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.functions.formats import full_name, mib, minute
from cleanlake.functions.predicates import all_of, file_conditions, is_previewable
from cleanlake.operators.orphans import unwritten
from cleanlake.policy import FileFilter, RetentionPolicy

PAGE_SIZE = 50
SHOWN_PER_PAGE = 1000
# What a page shows unless told otherwise.
PAGE_FILTER = FileFilter(min_mib=50)


def _user_columns(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("userid"),
        F.col("deleted").alias("user_deleted"),
        "firstname",
        "lastname",
    )


def matching_files(files: DataFrame, users: DataFrame, flt: FileFilter) -> DataFrame:
    """Records that meet the filter. Users are joined only when the filter asks for them.

    The user join never multiplies rows, since users are known by their primary key, so it can be
    left out of counts and pages that do not test user columns.
    """
    if flt.needs_user:
        how = "inner" if flt.given(flt.user_deleted) else "left"
        people = _user_columns(users)
        if how == "inner":
            people = people.where(F.col("user_deleted") == 1)
        files = files.join(people, "userid", how)
    return files.where(all_of(file_conditions(flt)))


def find_files(
    files: DataFrame,
    users: DataFrame,
    flt: FileFilter = FileFilter(),
    limit: int | None = PAGE_SIZE,
    offset: int = 0,
    after_hash: str | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """One record per content among the matching records, with its user, by content hash.

    The record shown for a content is the one with the lowest id. The grouping
    carries nothing but that id; the other columns are read for the page only. ``after_hash``
    continues behind a known hash, which stays cheap on deep pages; ``offset`` brings all rows
    before the page to one task, so it is for the first pages only. ``limit=None`` returns every
    content. The rows of a page are looked at twice: for the page and to cut the users down to its
    own. ``keep`` may write them.
    """
    found = matching_files(files, users, flt)
    if after_hash is not None:
        found = found.where(F.col("contenthash") > after_hash)
    page = found.groupBy("contenthash").agg(F.min("id").alias("id"))
    if limit is not None:
        page = page.orderBy("contenthash").offset(offset).limit(limit)
    rows = files.join(page.select("id"), "id", "left_semi")
    if limit is not None:
        return with_users(keep(rows, "page"), files, users)
    return rows.join(_user_columns(users), "userid", "left").select(
        *files.columns, "user_deleted", "firstname", "lastname"
    )


def with_users(rows: DataFrame, files: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of a page with their users, of whom only those of the page are looked for."""
    wanted = rows.where(F.col("userid").isNotNull()).select("userid").distinct()
    people = _user_columns(users).join(wanted, "userid", "left_semi")
    return rows.join(people, "userid", "left").select(
        *files.columns, "user_deleted", "firstname", "lastname"
    )


def count_files(
    files: DataFrame, users: DataFrame, flt: FileFilter = FileFilter(), page: int = 0
) -> DataFrame:
    """One row: matching records, distinct contents, and the total a pager shows."""
    per_content = (
        matching_files(files, users, flt)
        .groupBy("contenthash")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = per_content.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
        F.count(F.lit(1)).alias("n_contents"),
    )
    most = F.lit(SHOWN_PER_PAGE * (page + 1)).cast("bigint")
    return totals.withColumn("shown_total", F.least("n_records", most))


def file_page(
    files: DataFrame,
    users: DataFrame,
    flt: FileFilter = PAGE_FILTER,
    page: int = 0,
    page_size: int | None = None,
    after_hash: str | None = None,
    policy: RetentionPolicy = RetentionPolicy(),
) -> tuple[DataFrame, DataFrame]:
    """A page of the file search as display rows, and its counts.

    The page size is the policy's unless given. Deep pages should be asked for by the last hash of
    the one before (``after_hash``) instead of their number.
    """
    size = page_size or policy.items_per_page
    offset = 0 if after_hash is not None else page * size
    found = find_files(files, users, flt, size, offset, after_hash)
    return file_listing(found), count_files(files, users, flt, page)


def file_listing(found: DataFrame) -> DataFrame:
    """Display columns of found files. A user that is unknown counts as not deleted."""
    place = F.concat(
        F.coalesce("component", F.lit("")), F.lit(", "), F.coalesce("filearea", F.lit(""))
    )
    return found.select(
        "id",
        "filename",
        place.alias("place"),
        mib("filesize").alias("size_mib"),
        full_name().alias("user_name"),
        (F.coalesce("user_deleted", F.lit(0)) == 1).alias("user_deleted"),
        minute("timecreated").alias("created"),
        is_previewable().alias("previewable"),
    )
