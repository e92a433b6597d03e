"""The whole clean-up: plan it, report it, apply it.

Order matters, because later rules look at what earlier ones leave: modules and what
hangs on them, grades, logs, component files, ghosts, and last the check-out of files. The master
switch of the policy turns off all but the check-out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.operators import checkout, ghosts, modules, orphans, removal
from cleanlake.operators.key_sets import KeySet
from cleanlake.operators.vectors import delete_rows, deletion_vectors, read_files
from cleanlake.plans.rules import CleanupStep, Run, in_order
from cleanlake.plans.staging import Staging
from cleanlake.policy import RetentionPolicy
from cleanlake.sources.inventory import with_content_key

UNLINK_SCHEMA = "path string, reason string, bytes bigint"


class ModulesStep:
    """Modules of deleted courses, modules of stalled delete tasks, and their dependants."""

    name = "course_modules"

    def plan(self, run: Run) -> None:
        cm, types = run.tables["course_modules"], run.tables["modules"]
        removable = modules.with_module_names(cm, types).where(
            F.col("module_name").isNotNull()
        )
        if list(run.undeletable):
            removable = removable.where(~F.col("module_name").isin(*run.undeletable))
        lost = modules.orphan_modules(removable, run.keys(run.tables["course"])).select("id")
        lost = run.staging.keep(lost, "orphan_modules")
        rules = [("deleted_course", lost)]

        if run.has("task_adhoc"):
            stalled = modules.stalled_tasks(run.tables["task_adhoc"], run.policy, run.as_of)
            # Orphans are gone by the time tasks are tried: a task finds nothing left of them.
            listed = run.staging.keep(
                modules.stalled_task_modules(
                    stalled,
                    orphans.survivors(cm, run.keys(lost)),
                    types,
                    run.undeletable,
                    run.tables.get("course_sections"),
                ),
                "task_modules",
            )
            gone = listed.where(F.col("outcome").isin(modules.DELETED, modules.UNLISTED))
            rules.append(("stalled_task", gone.select(F.col("module_id").alias("id"))))
            done = modules.task_outcomes(listed).where("removed")
            run.doom(
                self.name,
                "task_adhoc",
                [("resolved_task", done.select(F.col("task_id").alias("id")))],
            )
        zero = F.lit(0).cast("bigint")
        found = orphans.first_rule([(n, r.select("id", zero.alias("bytes"))) for n, r in rules])
        found = run.staging.keep(found, "found_modules")
        ids = run.keys(found)
        gone = ids.having(cm, "id") if isinstance(ids, KeySet) else cm
        doomed = run.staging.keep(
            modules.doomed_modules(
                gone.join(found, "id"), types, run.tables.get("context"), run.policy
            ),
            "doomed_modules",
        )
        run.add(
            self.name,
            "course_modules",
            [name for name, _ in rules],
            doomed.select("id", "rule", "bytes").distinct(),
        )

        run.tombstones = modules.module_tombstones(doomed, cm)
        run.gone_modules = doomed
        cascades = run.cascade_rules
        if cascades is None:
            cascades = modules.module_cascade(run.policy)
        for rule in cascades:
            if not run.has(rule.table):
                run.skip(self.name, rule.table, rule.label)
                continue
            rows = modules.cascade_rows(
                doomed, run.tables[rule.table], rule, run.staging.once
            )
            run.doom(
                self.name,
                rule.table,
                [(rule.label, rows)],
                stage=rule.table in ("context", "files", "grade_items"),
                size="filesize" if rule.table == "files" else None,
            )


class GradesStep:
    """Seven rules on grade data, in this order."""

    name = "grades"
    after = ("course_modules",)

    def plan(self, run: Run) -> None:
        course = run.keys(run.tables["course"], "course")
        items = run.tables["grade_items"]
        run.doom(
            self.name,
            "grade_items",
            [
                ("deleted_course", orphans.grade_items_of_deleted_courses(items, course)),
                (
                    "deleted_module",
                    orphans.grade_items_of_deleted_modules(
                        items, run.live("course_modules"), run.staging.keep
                    ),
                ),
            ],
            stage=True,
        )
        items = run.keys(run.live_written("grade_items", "id"), "live-grade_items")
        if run.has("grade_grades"):
            parents = [
                ("deleted_item", items, "itemid"),
                # Users only flagged as deleted still have a row.
                ("deleted_user", run.keys(run.tables["user"], "user"), "userid"),
            ]
            found = orphans.first_parent_gone(run.tables["grade_grades"], parents)
            run.add(self.name, "grade_grades", [name for name, _, _ in parents], found)
        for table in ("grade_categories", "grade_outcomes_courses"):
            if run.has(table):
                rows = orphans.rows_of_deleted_courses(run.tables[table], course)
                run.doom(self.name, table, [("deleted_course", rows)])
        if run.has("grade_grades_history"):
            rows = orphans.grade_history_to_remove(
                run.tables["grade_grades_history"],
                items,
                run.policy.cutoff(run.as_of, run.policy.grade_history_days),
            )
            run.doom(self.name, "grade_grades_history", [("deleted_item_or_aged", rows)])


class LogsStep:
    """Log rows without a context or past their lifetime, in every log store there is."""

    name = "logs"
    after = ("course_modules",)
    stores = ("logstore_standard_log", "logstore_lanalytics_log")

    def plan(self, run: Run) -> None:
        cutoff = run.policy.cutoff(run.as_of, run.policy.log_days)
        context = None
        for store in self.stores:
            if not run.has(store):
                run.skip(self.name, store, "no_context_or_aged")
                continue
            context = context or run.keys(run.live_written("context", "id"), "live-context")
            rows = orphans.log_rows_to_remove(run.tables[store], context, cutoff)
            run.doom(self.name, store, [("no_context_or_aged", rows)])


class ComponentFilesStep:
    """Files of chosen components past their lifetime."""

    name = "component_files"
    after = ("course_modules",)

    def plan(self, run: Run) -> None:
        files = run.tables["files"]
        cutoff = run.policy.cutoff(run.as_of, run.policy.component_file_days)
        components = run.policy.components
        found = orphans.component_retention(files, components, cutoff).select(
            "id", F.col("component").alias("rule"), F.col("filesize").alias("bytes")
        )
        if components:
            run.add(self.name, "files", components, found, stage=True)


class GhostsStep:
    """Registered ghosts: their files are unlinked and their registry rows go.

    With ``recheck_ghosts`` a file whose content has got a record since the scan is
    left alone and only leaves the registry.
    """

    name = "ghost_files"
    after = ("course_modules", "component_files")

    def plan(self, run: Run) -> None:
        if not run.has("ghost_registry"):
            run.skip(self.name, "ghost_registry", "ghost")
            return
        registry = run.tables["ghost_registry"]
        doomed = registry
        rules = [("ghost", doomed)]
        if run.recheck_ghosts:
            doomed = ghosts.still_unlinked(registry, run.tables["files"], run.doomed.get("files"))
            rules = [("ghost", doomed), ("linked_again", registry)]
        doomed = run.staging.keep(doomed.select("id", "path", "size"), "ghost_paths")
        rules[0] = ("ghost", doomed)
        run.doom(self.name, "ghost_registry", rules, size="size")
        run.unlinks.append(
            doomed.groupBy("path")
            .agg(F.max("size").alias("bytes"))
            .select("path", F.lit("ghost").alias("reason"), "bytes")
        )


class CheckoutStep:
    """Check-out of file records against the content still stored."""

    name = "files_checkout"
    actions = (checkout.MISSING, checkout.GONE, checkout.BACKUP, checkout.DRAFT)

    def plan(self, run: Run) -> None:
        columns = ("id", "contenthash", "filename", "component", "filearea", "timecreated", "filesize")
        files, inventory = run.live_written("files", *columns), run.inventory
        gone = run.unlinked_paths()
        if gone is not None:
            inventory = inventory.join(gone.select("path"), "path", "left_anti")
            inventory = run.staging.keep(inventory, "live-inventory")
        args = (files, inventory, run.policy, run.as_of, run.safe_shared_content)
        found = checkout.checkout_doomed(*args, keep=run.staging.keep)
        found = run.staging.keep(found, "checkout")
        run.checked_out = found
        run.add(
            self.name, "files", self.actions, found.withColumnRenamed("action", "rule")
        )
        if run.safe_shared_content:
            hashes = checkout.unlink_hashes(*args)
        else:
            # Exactly one record per unlinked content has one of these actions.
            hashes = found.where(
                F.col("action").isin(checkout.BACKUP, checkout.DRAFT)
            ).select("contenthash", F.col("action").alias("reason"))
        run.unlinks.append(
            inventory.join(hashes, "contenthash").select(
                "path", "reason", F.col("length").alias("bytes")
            )
        )


def default_steps(policy: RetentionPolicy) -> list[CleanupStep]:
    steps: list[CleanupStep] = []
    if policy.auto_remove:
        steps = [ModulesStep(), GradesStep(), LogsStep(), ComponentFilesStep(), GhostsStep()]
    return [*steps, CheckoutStep()]


@dataclass(frozen=True)
class CleanupPlan:
    """Doomed rows per table ``(id, step, rule, bytes)``, files to unlink, module tombstones."""

    tables: Mapping[str, DataFrame]
    doomed: Mapping[str, DataFrame]
    unlinks: DataFrame
    catalog: Sequence[tuple[str, str, str, str]]
    checked_out: DataFrame | None = None
    tombstones: DataFrame | None = None
    gone_modules: DataFrame | None = None
    staging: Staging | None = None
    written: bool = False

    def close(self) -> None:
        """Remove the tables written while planning. The plan cannot be read afterwards; the
        one ``write`` returned can."""
        if self.staging is not None:
            self.staging.close()

    def write(self, location: str) -> CleanupPlan:
        """Write the plan as an audit and return it reading from there.

        Reports and removals then use exactly these rows, and nothing is computed twice.
        """
        staging = Staging(self.unlinks.sparkSession, location)
        return CleanupPlan(
            self.tables,
            {t: staging.keep(rows, f"doomed-{t}") for t, rows in self.doomed.items()},
            staging.keep(self.unlinks, "unlinks"),
            self.catalog,
            None if self.checked_out is None else staging.keep(self.checked_out, "checked_out"),
            None if self.tombstones is None else staging.keep(self.tombstones, "tombstones"),
            None if self.gone_modules is None else staging.keep(self.gone_modules, "gone_modules"),
            written=True,
        )


def plan_cleanup(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    inventory: DataFrame,
    policy: RetentionPolicy,
    as_of: int,
    steps: Sequence[CleanupStep] | None = None,
    staging: Staging | None = None,
    **options,
) -> CleanupPlan:
    """Plan a clean-up without changing anything. ``options`` are those of ``Run``.

    A step begins when the steps it names in ``after`` are through; steps that do not wait for each other
    run side by side. One that names none waits for all before it. With a ``ResumableStaging``
    the same plan, made again after it was broken off, goes on behind the last table that was written.
    """
    own = staging or Staging(spark)
    run = Run(tables, inventory, policy, as_of, own, **options)
    in_order(list(default_steps(policy) if steps is None else steps), run)
    unlinks = run.unlinked_paths()
    if unlinks is None:
        unlinks = spark.createDataFrame([], UNLINK_SCHEMA)
    return CleanupPlan(
        tables,
        run.doomed,
        unlinks,
        run.catalog,
        run.checked_out,
        run.tombstones,
        run.gone_modules,
        own,
    )


def cleanup_report(spark: SparkSession, plan: CleanupPlan) -> DataFrame:
    """``(seq, step, table, rule, rows, bytes, status)``, one row per rule.

    ``status`` is ``none`` for a rule without rows and ``skipped`` for an absent table.
    """
    catalog = spark.createDataFrame(
        [(i, *entry) for i, entry in enumerate(plan.catalog, start=1)],
        "seq bigint, step string, table string, rule string, status string",
    )
    counts = [
        rows.groupBy("step", "rule")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
        .withColumn("table", F.lit(table))
        for table, rows in plan.doomed.items()
    ]
    zero = F.lit(0).cast("bigint")
    status = F.when(F.col("status") == "skipped", "skipped").when(
        F.col("rows").isNull(), "none"
    )
    joined = catalog.join(reduce(DataFrame.unionByName, counts), ["step", "table", "rule"], "left")
    return joined.select(
        "seq",
        "step",
        "table",
        "rule",
        F.coalesce("rows", zero).alias("rows"),
        F.coalesce("bytes", zero).alias("bytes"),
        status.otherwise("ok").alias("status"),
    )


def apply_cleanup(
    spark: SparkSession,
    plan: CleanupPlan,
    target: str,
    root: str | None = None,
    dry_run: bool = True,
    partition_by: Mapping[str, Sequence[str]] = MappingProxyType({}),
    located: Mapping[str, str] = MappingProxyType({}),
) -> dict[str, DataFrame]:
    """Carry the plan out: audit first, then files, then new versions of the tables.

    Tables are written below ``target`` and never over the version being read, so a run that fails
    leaves the data as it was. Only tables that lose rows are written; of one with ``partition_by``
    columns only the partitions that do, so swap in those and leave the others. ``touched-<table>``
    names these partitions: one that has no folder in the new table has lost all its rows and is to be
    dropped. Of a table whose files lie at ``located[table]`` only files that lose rows are written, and
    the new version reads the others where they are. Section lists are written anew where a deleted module is taken out of them. File records stay when their
    content could not be unlinked. A dry run writes the audit and no table.
    Returns the new tables, with the fate of each file under ``unlinked`` and records of the
    deleted modules under ``tombstones``.
    """
    if not plan.written:
        plan = plan.write(f"{target}/audit")
    dry_run = dry_run or root is None
    staging = Staging(spark, target)
    unlinked = removal.unlink_files(plan.unlinks, root or "", dry_run=dry_run)
    done = {"unlinked": staging.keep(unlinked, "unlinked")}
    if plan.tombstones is not None:
        done["tombstones"] = plan.tombstones
    if dry_run:
        return done
    for table, doomed in plan.doomed.items():
        if table == "files" and plan.checked_out is not None:
            doomed = _without_failed_unlinks(doomed, plan.checked_out, done["unlinked"])
        if doomed.isEmpty():
            continue
        rows, parts = plan.tables[table], partition_by.get(table, ())
        if table in located:
            place = located[table]
            found = deletion_vectors(read_files(spark, place, rows.schema), doomed)
            version = delete_rows(
                spark, place, rows.schema, found, f"{staging.folder}/table-{table}", parts
            )
            done[table] = version.read()
            done[f"manifest-{table}"] = version.manifest
            continue
        if parts:
            touched = rows.join(doomed.select("id"), "id", "left_semi").select(*parts).distinct()
            touched = done[f"touched-{table}"] = staging.keep(touched, f"touched-{table}")
            same = reduce(Column.__and__, [rows[c].eqNullSafe(touched[c]) for c in parts])
            rows = rows.join(touched, same, "left_semi")
        kept = orphans.survivors(rows, doomed).select(*plan.tables[table].columns)
        done[table] = staging.keep(kept, f"table-{table}", parts)
    if plan.gone_modules is not None and "course_sections" in plan.tables:
        sections = plan.tables["course_sections"]
        after = modules.sections_without(sections, plan.gone_modules)
        done["course_sections"] = staging.keep(after, "table-course_sections")
    return done


def _without_failed_unlinks(doomed, checked_out, unlinked) -> DataFrame:
    failed = with_content_key(unlinked.where(F.col("status") == removal.ERROR))
    stuck = (
        checked_out.where(F.col("action") != checkout.MISSING)
        .join(failed.select("contenthash"), "contenthash", "left_semi")
        .select("id")
    )
    return doomed.join(stuck, "id", "left_anti")
