"""Rows whose parent is gone, and rows past their time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.functions.predicates import all_of, holds, older_than
from cleanlake.operators.key_sets import KeySet


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def unwritten(frame: DataFrame, label: str) -> DataFrame:
    """The default of ``keep``: the frame as it is."""
    return frame


def orphans(
    child: DataFrame,
    parent: DataFrame | KeySet,
    fk: str | Sequence[str],
    pk: str | Sequence[str] = "id",
    null_fk: str = "doom",
    unique_parent: bool = True,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """Rows of ``child`` without a row in ``parent``.

    A null foreign key has no parent, so such a row is doomed; ``null_fk="keep"``
    spares it. A parent known by its primary key is joined as it is: both sides are then
    plain shuffles and adaptive execution can split a hot foreign key. Pass
    ``unique_parent=False`` when parent keys repeat, so they are reduced before the shuffle.
    That rules the split out, unless ``keep`` (``Staging.keep``, say) writes the reduced keys.
    A ``KeySet`` of the parent's keys leaves the children where they are.
    """
    fks, pks = _names(fk), _names(pk)
    if null_fk == "keep":
        child = child.where(all_of(F.col(c).isNotNull() for c in fks))
    elif null_fk != "doom":
        raise ValueError("null_fk is 'doom' or 'keep'")
    if isinstance(parent, KeySet):
        return parent.lacking(child, fks[0])
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(fks, pks)])
    if not unique_parent:
        keys = keep(keys.distinct(), "parent-keys")
    return child.join(keys, fks, "left_anti").select(*child.columns)


def orphan_or_aged(
    child: DataFrame,
    parent: DataFrame | KeySet,
    fk: str,
    ts: str,
    cutoff: int,
    pk: str = "id",
) -> DataFrame:
    """Rows without a parent or older than ``cutoff``, with the ``reason``.

    The two arms are disjoint. Aged rows need no join, and the time filter of
    each arm reaches the scan.
    """
    old = older_than(ts, cutoff)
    aged = child.where(old).withColumn("reason", F.lit("aged"))
    fresh = child.where((F.col(ts) >= F.lit(cutoff)) | F.col(ts).isNull())
    lost = orphans(fresh, parent, fk, pk)
    return aged.unionByName(lost.withColumn("reason", F.lit("orphan")))


def component_retention(
    files: DataFrame, components: Sequence[str], cutoff: int
) -> DataFrame:
    """Files of the given components created before ``cutoff``."""
    return files.where(
        F.col("component").isin(*components) & older_than("timecreated", cutoff)
    )


def grade_items_of_deleted_courses(grade_items: DataFrame, course: DataFrame | KeySet) -> DataFrame:
    # Items that never belonged to a course stay.
    return orphans(grade_items, course, "courseid", null_fk="keep")


def grade_items_of_deleted_modules(
    grade_items: DataFrame,
    course_modules: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """Module grade items whose (course, instance) has no module, of whatever type."""
    return orphans(
        grade_items.where(F.col("itemtype") == "mod"),
        course_modules,
        ("courseid", "iteminstance"),
        ("course", "instance"),
        unique_parent=False,
        keep=keep,
    )


def grades_of_deleted_items(grades: DataFrame, grade_items: DataFrame | KeySet) -> DataFrame:
    return orphans(grades, grade_items, "itemid")


def grades_of_deleted_users(grades: DataFrame, users: DataFrame) -> DataFrame:
    """Grades whose user row is gone. Users only flagged as deleted still have one."""
    return orphans(grades, users, "userid")


def rows_of_deleted_courses(
    rows: DataFrame, course: DataFrame | KeySet, null_fk: str = "doom"
) -> DataFrame:
    """Grade categories or course outcomes whose course is gone."""
    return orphans(rows, course, "courseid", null_fk=null_fk)


def grade_history_to_remove(
    history: DataFrame, grade_items: DataFrame | KeySet, cutoff: int
) -> DataFrame:
    return orphan_or_aged(history, grade_items, "itemid", "timemodified", cutoff)


def log_rows_to_remove(log: DataFrame, context: DataFrame | KeySet, cutoff: int) -> DataFrame:
    return orphan_or_aged(log, context, "contextid", "timecreated", cutoff)


def first_rule(rules: Sequence[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """One row per doomed key with the first of the ordered rules that dooms it.

    Each frame has ``key`` and ``bytes``. Only doomed keys are shuffled, not the table, and
    ranks are numbers, so the aggregate stays a hash aggregate with a map-side part. The rows
    of a single rule are rows of the table, distinct already, and are not shuffled at all.
    """
    if len(rules) == 1:
        name, frame = rules[0]
        return frame.select(key, F.lit(name).alias("rule"), "bytes")
    ranked = [
        frame.select(key, "bytes", F.lit(rank).alias("rank"))
        for rank, (_, frame) in enumerate(rules, start=1)
    ]
    return _lowest_rank(reduce(DataFrame.unionByName, ranked), [name for name, _ in rules], key)


def _lowest_rank(ranked: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    labels = F.array(*[F.lit(name) for name in names])
    return (
        ranked.groupBy(key)
        .agg(F.min("rank").alias("rank"), F.max("bytes").alias("bytes"))
        .select(key, F.element_at(labels, F.col("rank")).alias("rule"), "bytes")
    )


def first_parent_gone(
    child: DataFrame, parents: Sequence[tuple[str, DataFrame | KeySet, str]], key: str = "id"
) -> DataFrame:
    """``first_rule`` of rows without a row in one of ``parents``: (rule, parent, foreign key).

    Where all parents are key sets, ``child`` is read once for all of them, and a row that several rules
    doom is shuffled once.
    """
    zero = F.lit(0).cast("bigint").alias("bytes")
    if not all(isinstance(parent, KeySet) for _, parent, _ in parents):
        return first_rule([(name, orphans(child, p, fk).select(key, zero)) for name, p, fk in parents], key)
    rows = child.select(key, *dict.fromkeys(fk for _, _, fk in parents))
    marks = [f"_has_{rank}" for rank in range(len(parents))]
    for mark, (_, parent, fk) in zip(marks, parents):
        rows = parent.marking(rows, fk, mark)
    first = F.coalesce(*[F.when(~F.col(m), F.lit(rank)) for rank, m in enumerate(marks, start=1)])
    ranked = rows.select(key, zero, first.alias("rank")).where(F.col("rank").isNotNull())
    return _lowest_rank(ranked, [name for name, _, _ in parents], key)


def survivors(table: DataFrame, doomed: DataFrame | KeySet, key: str = "id") -> DataFrame:
    """The table without the doomed rows."""
    if isinstance(doomed, KeySet):
        return doomed.lacking(table, key)
    return table.join(doomed.select(key), key, "left_anti")


def without(table: DataFrame, condition) -> DataFrame:
    """The table without the rows that meet the condition; unknown does not meet it."""
    return table.where(~holds(condition))
