"""Row predicates as Column expressions, so they reach the parquet scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cleanlake.policy import FileFilter

MIB = 1024 * 1024


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def holds(condition: Column) -> Column:
    """The condition with unknown taken as false, so it can be negated safely."""
    return F.coalesce(condition, F.lit(False))


def older_than(ts: str, cutoff: int, inclusive: bool = False) -> Column:
    """``ts`` before the cut-off. A null time is not old."""
    return F.col(ts) <= F.lit(cutoff) if inclusive else F.col(ts) < F.lit(cutoff)


def time_range(
    ts: Column, until: int | None = None, newer: bool = False, since: int | None = None
) -> Column | None:
    """Period of the file statistics.

    Both bounds give ``[since, until)``; ``until`` alone gives the rows strictly
    after (``newer``) or before it; ``since`` alone does not restrict.
    """
    if until is None:
        return None
    if since is not None:
        return (ts >= F.lit(since)) & (ts < F.lit(until))
    return ts > F.lit(until) if newer else ts < F.lit(until)


def larger_than_mib(size: str, mib: int) -> Column:
    return F.col(size) > F.lit(int(mib * MIB)).cast("bigint")


def contains_pattern(text: str) -> str:
    """LIKE pattern for "contains", keeping the caller's ``%`` and ``_`` wildcards.

    A backslash before an ordinary character stands for that character.
    """
    return "%" + re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], text) + "%"


def _like(col: Column, text: str, case_sensitive: bool) -> Column:
    pattern = contains_pattern(text)
    return col.like(pattern) if case_sensitive else col.ilike(pattern)


def file_conditions(flt: FileFilter) -> list[Column]:
    """Conditions of a file search over files, with user columns where it needs them."""
    conditions = [larger_than_mib("filesize", flt.min_mib)]
    if flt.given(flt.component):
        conditions.append(F.col("component") == flt.component)
    if flt.given(flt.name_like):
        conditions.append(_like(F.col("filename"), flt.name_like, flt.case_sensitive))
    if flt.given(flt.user_like):
        first, last = F.col("firstname"), F.col("lastname")
        names = (
            F.concat(first, F.lit(" "), last),
            F.concat(last, F.lit(" "), first),
            F.col("author"),
        )
        a, b, c = (_like(n, flt.user_like, flt.case_sensitive) for n in names)
        conditions.append(a | b | c)
    if flt.given(flt.user_deleted):
        conditions.append(F.col("user_deleted") == 1)
    return conditions


def is_backup_name(name: str = "filename") -> Column:
    # Case-sensitive; one final newline is allowed.
    return F.col(name).rlike(r"\.mbz\n?\z")


def is_draft(area: str = "filearea") -> Column:
    return F.col(area) == "draft"


def is_previewable() -> Column:
    """Files with a page of their own: module files and course backups."""
    return F.col("component").startswith("mod_") | (
        (F.col("component") == "backup") & (F.col("filearea") == "course")
    )


def file_time() -> Column:
    """Time a file counts by in the statistics: backups by change, others by creation."""
    return F.when(F.col("component") == "backup", F.col("timemodified")).otherwise(
        F.col("timecreated")
    )
