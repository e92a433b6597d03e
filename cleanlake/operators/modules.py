"""Course modules: orphans, stalled delete tasks, cascades, tombstones, new tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.functions.payload import listed_modules, module_payload
from cleanlake.functions.predicates import older_than
from cleanlake.operators.key_sets import KeySet, is_whole, key_set
from cleanlake.operators.orphans import orphans, unwritten
from cleanlake.policy import RetentionPolicy

ABSENT, DELETED, FAILED = "absent", "deleted", "failed"
LEFT, UNLISTED = "left_in_place", "unlisted"


def orphan_modules(course_modules: DataFrame, course: DataFrame | KeySet) -> DataFrame:
    return orphans(course_modules, course, "course")


def with_module_names(course_modules: DataFrame, modules: DataFrame) -> DataFrame:
    """Adds ``module_name``, null when the module type is unknown."""
    names = modules.select(F.col("id").alias("module"), F.col("name").alias("module_name"))
    return course_modules.join(names, "module", "left").select(
        *course_modules.columns, "module_name"
    )


def stalled_tasks(tasks: DataFrame, policy: RetentionPolicy, as_of: int) -> DataFrame:
    """Failed module deletions that started before the cut-off."""
    cutoff = policy.cutoff(as_of, policy.module_task_days)
    return tasks.where(
        (F.col("classname") == policy.module_delete_task)
        & (F.col("faildelay") > 0)
        & older_than("timestarted", cutoff)
    )


def stalled_task_modules(
    stalled: DataFrame,
    course_modules: DataFrame,
    modules: DataFrame,
    undeletable: Iterable[str] = (),
    sections: DataFrame | None = None,
) -> DataFrame:
    """``(task_id, module_id, outcome)`` for each module a task lists.

    A module that no longer exists is ``absent``, one of an unknown type ``failed``, one
    of an ``undeletable`` type ``left_in_place``. With ``sections`` a module its section does
    not list is ``unlisted``: its data goes, but its task has failed. Tasks that list nothing
    have one row without a module.
    """
    listed = listed_modules(stalled).select("task_id", "module_id")
    known = with_module_names(course_modules, modules)
    unlisted = F.lit(False)
    if sections is not None:
        known = _with_section_flag(known, sections)
        unlisted = ~F.col("in_section")
    undeletable = list(undeletable)
    left = F.col("module_name").isin(*undeletable) if undeletable else F.lit(False)
    outcome = (
        F.when(F.col("module_name").isNull(), FAILED)
        .when(left, LEFT)
        .when(unlisted, UNLISTED)
        .otherwise(DELETED)
    )
    status = known.select(F.col("id").alias("module_id"), outcome.alias("outcome"))
    joined = listed.join(status, "module_id", "left")
    return joined.select(
        "task_id",
        "module_id",
        F.when(
            F.col("module_id").isNotNull(), F.coalesce("outcome", F.lit(ABSENT))
        ).alias("outcome"),
    )


def _with_section_flag(course_modules: DataFrame, sections: DataFrame) -> DataFrame:
    places = sections.select(
        F.col("id").alias("section"),
        F.explode(F.array_distinct(F.split("sequence", r"\s*,\s*"))).alias("listed"),
    ).select("section", "listed", F.trim("listed").try_cast("bigint").alias("id"))
    joined = course_modules.join(places, ["id", "section"], "left")
    return joined.select(
        *course_modules.columns, F.col("listed").isNotNull().alias("in_section")
    )


def task_outcomes(task_modules: DataFrame) -> DataFrame:
    """``(task_id, n_modules, n_failed, removed)``; a task goes when none failed."""
    failed = F.count(F.when(F.col("outcome").isin(FAILED, UNLISTED), 1))
    return task_modules.groupBy("task_id").agg(
        F.count("module_id").alias("n_modules"),
        failed.alias("n_failed"),
        (failed == 0).alias("removed"),
    )


@dataclass(frozen=True)
class CascadeRule:
    """Rows of ``table`` that go with a module: column pairs that must agree, and constants.

    ``keys`` maps columns of the table to columns of the doomed modules (``id``, ``course``,
    ``instance``, ``section``, ``module_name``, ``component``, ``contextid``).
    """

    table: str
    keys: Mapping[str, str]
    where: Mapping[str, object] = field(default_factory=dict)
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or f"module_{self.table}"


def module_cascade(policy: RetentionPolicy = RetentionPolicy()) -> tuple[CascadeRule, ...]:
    """What goes with a module. Further tables of the host application take rules of their own."""
    return (
        CascadeRule(
            "context", {"instanceid": "id"}, {"contextlevel": policy.module_context_level}
        ),
        CascadeRule("files", {"contextid": "contextid"}),
        CascadeRule("event", {"instance": "instance", "modulename": "module_name"}),
        CascadeRule(
            "grade_items",
            {"itemmodule": "module_name", "iteminstance": "instance", "courseid": "course"},
            {"itemtype": "mod"},
        ),
        CascadeRule("course_modules_completion", {"coursemoduleid": "id"}),
        CascadeRule("course_modules_viewed", {"coursemoduleid": "id"}),
        CascadeRule(
            "course_completion_criteria",
            {"moduleinstance": "id", "course": "course"},
            {"criteriatype": policy.activity_criterion},
        ),
    )


def tag_cascade(table: str = "tag_instance") -> tuple[CascadeRule, ...]:
    """Tags put on a module's content, and tags put on the module itself."""
    return (
        CascadeRule(
            table,
            {"component": "component", "contextid": "contextid"},
            name="module_content_tags",
        ),
        CascadeRule(
            table,
            {"itemid": "id"},
            {"component": "core", "itemtype": "course_modules"},
            name="module_tags",
        ),
    )


def by_module_context(table: str, column: str = "contextid") -> CascadeRule:
    """Rows tied to the module's context, such as blog associations or question references."""
    return CascadeRule(table, {column: "contextid"})


def by_module(table: str, column: str) -> CascadeRule:
    """Rows tied to the module's id, such as competency links."""
    return CascadeRule(table, {column: "id"})


def doomed_modules(
    course_modules: DataFrame,
    modules: DataFrame,
    context: DataFrame | None = None,
    policy: RetentionPolicy = RetentionPolicy(),
) -> DataFrame:
    """Modules with the columns cascades refer to. Those of an unknown type are left out."""
    named = with_module_names(course_modules, modules).where(F.col("module_name").isNotNull())
    named = named.withColumn("component", F.concat(F.lit("mod_"), "module_name"))
    if context is None:
        return named.withColumn("contextid", F.lit(None).cast("bigint"))
    contexts = context.where(F.col("contextlevel") == policy.module_context_level).select(
        F.col("instanceid").alias("id"), F.col("id").alias("contextid")
    )
    return named.join(contexts, "id", "left")


def cascade_rows(
    doomed: DataFrame,
    table: DataFrame,
    rule: CascadeRule,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """Rows of ``table`` the rule dooms.

    Keys of the modules are reduced to distinct ones first. ``keep`` may write them; their size is
    known then, and they go to the rows as a set where that is small; where they are too many to broadcast
    a hot key of the table is split. Rules that refer to the same columns of a module ask for the same
    keys, under the same label.
    """
    for column, value in rule.where.items():
        table = table.where(F.col(column) == F.lit(value))
    columns = sorted(set(rule.keys.values()))
    keys = keep(doomed.select(*columns).dropna().distinct(), "keys-" + "-".join(columns))
    if keep is not unwritten and len(rule.keys) == 1:
        ((column, key),) = rule.keys.items()
        found = key_set(keys, key) if is_whole(table, column) else None
        if found:
            return found.having(table, column)
    keys = keys.select(*[F.col(m).alias(c) for c, m in rule.keys.items()])
    return table.join(keys, list(rule.keys), "left_semi").select(*table.columns)


def cascade(
    doomed: DataFrame, tables: Mapping[str, DataFrame], rules: Sequence[CascadeRule]
) -> dict[str, DataFrame]:
    """Doomed rows per rule, for the tables that are there."""
    return {
        rule.label: cascade_rows(doomed, tables[rule.table], rule)
        for rule in rules
        if rule.table in tables
    }


def remove_from_sections(sections: DataFrame, doomed: DataFrame) -> DataFrame:
    """Sections whose module list changes, with the doomed modules taken out of it.

    The list of a section is one text value and is put together again from its own parts.
    """
    touched = doomed.select(F.col("section").alias("id")).distinct()
    parts = sections.join(touched, "id", "left_semi").select(
        F.col("id").alias("section"), F.posexplode(F.split("sequence", ",")).alias("pos", "cm")
    ).withColumn("cm", F.trim("cm").try_cast("bigint"))
    gone = doomed.select(F.col("id").alias("cm"), "section", F.lit(True).alias("gone"))
    marked = parts.join(gone, ["cm", "section"], "left")
    kept = F.when(F.col("gone").isNull(), F.struct("pos", "cm"))
    lists = marked.groupBy("section").agg(
        F.array_sort(F.collect_list(kept)).alias("kept"), F.max("gone").alias("gone")
    )
    text = F.concat_ws(",", F.transform("kept", lambda p: p["cm"].cast("string")))
    return lists.where("gone").select(F.col("section").alias("id"), text.alias("sequence"))


def sections_without(sections: DataFrame, doomed: DataFrame) -> DataFrame:
    """All sections, those that listed doomed modules with a shorter list."""
    changed = remove_from_sections(sections, doomed)
    changed = changed.withColumnRenamed("sequence", "shorter")
    return (
        sections.join(changed, "id", "left")
        .withColumn("sequence", F.coalesce("shorter", "sequence"))
        .select(*sections.columns)
    )


def module_tombstones(doomed: DataFrame, course_modules: DataFrame) -> DataFrame:
    """Audit record of each deleted module, with a snapshot of its row."""
    snapshot = F.struct(*[F.col(c) for c in course_modules.columns])
    return doomed.select(
        F.col("course").alias("courseid"),
        "contextid",
        F.col("id").alias("objectid"),
        F.col("module_name").alias("modulename"),
        F.col("instance").alias("instanceid"),
        snapshot.alias("snapshot"),
    )


def requeue_tasks(
    course_modules: DataFrame,
    user_id: int,
    policy: RetentionPolicy = RetentionPolicy(),
    block: int | None = None,
) -> DataFrame:
    """New deletion tasks for modules marked as being deleted: one per course.

    The payload of a task is one text value, so a course's pending ids come together in it. Where that
    is too much, ``block`` cuts every course alike into blocks of ids that wide, with a task each.
    """
    pending = course_modules.where(F.col("deletioninprogress") == 1).select("course", "id")
    part = F.lit(0) if block is None else F.floor(F.col("id") / F.lit(block))
    tasks = pending.groupBy("course", part.alias("part")).agg(
        F.array_sort(F.collect_list("id")).alias("ids")
    )
    return tasks.select(
        "course",
        F.size("ids").cast("bigint").alias("n_modules"),
        F.lit(policy.module_delete_task).alias("classname"),
        module_payload(F.col("ids"), user_id).alias("customdata"),
    )


def without_requeued(tasks: DataFrame, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    """Tasks left after the module deletions are dropped to be queued anew."""
    return tasks.where(
        F.col("classname").isNull() | (F.col("classname") != policy.module_delete_task)
    )

