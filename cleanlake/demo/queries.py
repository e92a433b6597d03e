"""Every operation of the library as a query over the derived views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.demo import views
from cleanlake.demo.views import Views
from cleanlake.functions.clock import years_before
from cleanlake.functions.formats import format_bytes, gib, mib
from cleanlake.functions.mime import sniff_text
from cleanlake.functions.payload import listed_modules
from cleanlake.functions.predicates import is_backup_name, older_than
from cleanlake.operators import (
    aged_files,
    bucketed_registry,
    checkout,
    fixpoint,
    ghosts,
    links,
    modules,
    orphans,
    pages,
    removal,
    rollup,
    search,
    statistics,
    vectors,
)
from cleanlake.plans import cleanup
from cleanlake.plans.requeue import requeued_tasks
from cleanlake.plans.rules import Rule
from cleanlake.plans.staging import Staging
from cleanlake.policy import DAY, FileFilter, RetentionPolicy
from cleanlake.sources.footers import data_files

A = views.AS_OF
POLICY = RetentionPolicy(
    auto_remove=True,
    log_days=(A - views.LOG_CUTOFF) // DAY,
    grade_history_days=(A - views.HISTORY_CUTOFF) // DAY,
    module_delete_task=views.DELETE_TASK,
)
COMPONENTS = POLICY.components


def tables_of(v: Views) -> dict[str, DataFrame]:
    return {
        "course": v.course,
        "course_modules": v.course_modules,
        "modules": v.modules,
        "context": v.context,
        "user": v.grader,
        "grade_items": v.grade_items,
        "grade_grades": v.grade_grades,
        "grade_categories": v.grade_categories,
        "grade_outcomes_courses": v.grade_categories,
        "grade_grades_history": v.grade_history,
        "logstore_standard_log": v.log,
        "files": v.files,
        "task_adhoc": v.task,
        "event": v.event,
        "course_modules_completion": v.completion,
        "course_modules_viewed": v.viewed,
        "course_completion_criteria": v.criteria,
        "ghost_registry": v.registry,
    }


def _plan(v: Views, **options) -> cleanup.CleanupPlan:
    return cleanup.plan_cleanup(v.spark, tables_of(v), v.disk, POLICY, A, **options)


def cleanup_report(v: Views) -> DataFrame:
    return cleanup.cleanup_report(v.spark, _plan(v))


def cleanup_report_checkout_only(v: Views) -> DataFrame:
    policy = replace(POLICY, auto_remove=False)
    plan = cleanup.plan_cleanup(v.spark, tables_of(v), v.disk, policy, A)
    return cleanup.cleanup_report(v.spark, plan)


def cleanup_doomed(v: Views) -> DataFrame:
    parts = [
        rows.select(
            F.lit(table).alias("table"), F.col("id").cast("string").alias("id"), "step", "rule"
        )
        for table, rows in _plan(v).doomed.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def cleanup_unlinks(v: Views) -> DataFrame:
    return _plan(v, recheck_ghosts=False).unlinks


def logs_orphan_or_aged(v: Views) -> DataFrame:
    return orphans.log_rows_to_remove(v.log, v.context, views.LOG_CUTOFF)


def analytics_logs_orphan_or_aged(v: Views) -> DataFrame:
    return orphans.log_rows_to_remove(v.analytics_log, v.context, POLICY.cutoff(A, 500))


def grade_items_first_rule(v: Views) -> DataFrame:
    items = v.grade_items.withColumn("bytes", F.lit(0).cast("bigint"))
    doomed = orphans.first_rule(
        [
            ("deleted_course", orphans.grade_items_of_deleted_courses(items, v.course)),
            ("deleted_module", orphans.grade_items_of_deleted_modules(items, v.course_modules)),
        ]
    )
    return doomed.select("id", "rule")


def component_retention(v: Views) -> DataFrame:
    cutoff = POLICY.cutoff(A, POLICY.component_file_days)
    found = orphans.component_retention(v.files, COMPONENTS, cutoff)
    return found.select("id", "component", "timecreated")


def _stalled(v: Views) -> DataFrame:
    return modules.stalled_tasks(v.task, POLICY, A)


def _task_modules(v: Views) -> DataFrame:
    return modules.stalled_task_modules(_stalled(v), v.course_modules, v.modules)


def _doomed_modules(v: Views) -> DataFrame:
    lost = modules.orphan_modules(v.course_modules, v.course)
    return modules.doomed_modules(lost, v.modules, v.context)


def _cascade(table: str, view: str) -> Callable[[Views], DataFrame]:
    def query(v: Views) -> DataFrame:
        rule = next(r for r in modules.module_cascade() if r.table == table)
        return modules.cascade_rows(_doomed_modules(v), getattr(v, view), rule)

    return query


def _cascade_by(rule: modules.CascadeRule, view: str) -> Callable[[Views], DataFrame]:
    return lambda v: modules.cascade_rows(_doomed_modules(v), getattr(v, view), rule)


def stalled_tasks_with_sections(v: Views) -> DataFrame:
    known = modules.with_module_names(v.course_modules, v.modules)
    lost = modules.orphan_modules(known.where(F.col("module_name").isNotNull()), v.course)
    left = orphans.survivors(v.course_modules, lost)
    listed = modules.stalled_task_modules(_stalled(v), left, v.modules, (), v.sections)
    return modules.task_outcomes(listed)


def sections_after_cleanup(v: Views) -> DataFrame:
    tables = tables_of(v) | {"course_sections": v.sections}
    plan = cleanup.plan_cleanup(
        v.spark, tables, v.disk, POLICY, A, [cleanup.ModulesStep()], cascade_rules=()
    )
    return modules.sections_without(v.sections, plan.gone_modules)


def module_tombstones(v: Views) -> DataFrame:
    stones = modules.module_tombstones(_doomed_modules(v), v.course_modules)
    return stones.withColumn("snapshot", F.to_json("snapshot"))


def scan_ghosts(v: Views) -> DataFrame:
    return ghosts.scan_ghosts(v.disk, v.files)


def upsert_registry(v: Views) -> DataFrame:
    found = scan_ghosts(v).withColumn("mime", F.lit("application/octet-stream"))
    return ghosts.upsert_registry(v.registry, ghosts.registry_rows(found), Staging(v.spark).keep)


def find_files_page_by_ranges(v: Views) -> DataFrame:
    """The second page of large files, found by the counts of ranges."""
    found = pages.content_pages(v.files, v.user, FileFilter(min_mib=50), Staging(v.spark), 8)
    return found.page(1, 20)


def cleanup_own_rules(v: Views) -> DataFrame:
    """A clean-up whose steps are rules of its own, of which the later one sees what the first left."""
    steps = [
        Rule("large_drafts", "files", lambda run: run.live("files").where("filearea = 'draft' and filesize > 20000000"), "filesize"),
        Rule("of_nobody", "files", lambda run: orphans.orphans(run.live("files"), v.user, "userid"), "filesize"),
        Rule("no_course", "grade_categories", lambda run: run.live("grade_categories").where("courseid is null")),
        Rule("absent_table", "blog", lambda run: run.live("blog")),
    ]
    plan = cleanup.plan_cleanup(v.spark, tables_of(v), v.disk, POLICY, A, steps)
    return cleanup.cleanup_report(v.spark, plan)


def stored_bytes(v: Views) -> DataFrame:
    """Whether the report of a table that lies in files counts those files' bytes, for each period."""
    staging, folder = _stored(v, v.log.repartition(3), "log")
    known = [statistics.HistoryTable("logstore_standard_log", v.log, "timecreated")]
    paths = {"logstore_standard_log": folder}
    report = statistics.usage_statistics(v.spark, v.files, COMPONENTS, known, A, paths)
    size = data_files(v.spark, folder).agg(F.sum("length").cast("double").alias("size"))
    size = size.first()["size"]
    rows = report.where(F.col("section") == "history")
    whole = F.when(F.col("period") == "all", F.col("n_bytes") == size).otherwise(F.col("n_bytes") <= size)
    return rows.select("item", "period", "n", whole.alias("of_the_files"))


def registry_in_buckets(v: Views) -> DataFrame:
    """The registry after a scan that wrote only the buckets that changed."""
    staging = Staging(v.spark)
    stored = bucketed_registry.BucketedRegistry(v.spark, f"{staging.folder}/registry", 64)
    stored.create(v.registry)
    found = scan_ghosts(v).withColumn("mime", F.lit("application/octet-stream"))
    stored.upsert(ghosts.registry_rows(found), staging)
    return stored.read()


def sniff_mime(v: Views) -> DataFrame:
    texts = [
        v.raw("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), sniff_text("html").alias("mime")),
        v.raw("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), sniff_text("text").alias("mime")),
    ]
    return texts[0].unionByName(texts[1])


def _checkout_args(v: Views):
    return v.files, v.disk, POLICY, A


def _chosen(v: Views) -> DataFrame:
    return v.raw("labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))


def find_files_user(v: Views) -> DataFrame:
    flt = FileFilter(min_mib=20, user_like="MACH", user_deleted=1)
    return search.find_files(v.files, v.user, flt, limit=None).select(
        "id", "contenthash", "filename", "user_deleted", "firstname", "lastname"
    )


def find_files_listing(v: Views) -> DataFrame:
    flt = FileFilter(component="backup", name_like="_1")
    return search.file_listing(search.find_files(v.files, v.user, flt, limit=None))


def component_stats_year_before(v: Views) -> DataFrame:
    return statistics.component_stats(
        v.files, "backup", until=years_before(A, 1), since=years_before(A, 2)
    )


def history_stats(v: Views) -> DataFrame:
    return statistics.history_stats(
        v.spark,
        [
            statistics.HistoryTable("logstore_standard_log", v.log, "timecreated"),
            statistics.HistoryTable("logstore_lanalytics_log", v.analytics_log, "timecreated", 7_000_000),
            statistics.HistoryTable("grade_items_history", None, "timemodified"),
        ],
        views.LOG_AS_OF,
    )


def grade_history_stats(v: Views) -> DataFrame:
    table = statistics.HistoryTable("grade_grades_history", v.grade_history, "timemodified")
    return statistics.history_stats(v.spark, [table], views.GRADE_AS_OF)


def usage_statistics(v: Views) -> DataFrame:
    known = {
        "logstore_standard_log": v.log,
        "logstore_lanalytics_log": v.analytics_log,
        "grade_grades_history": v.grade_history,
    }
    history = [
        statistics.HistoryTable(name, known.get(name), ts)
        for name, ts in statistics.HISTORY_TABLES
    ]
    return statistics.usage_statistics(v.spark, v.files, COMPONENTS, history, A)


def apply_deletes_survivors(v: Views) -> DataFrame:
    return orphans.survivors(v.log, logs_orphan_or_aged(v))


def files_sizes(v: Views) -> DataFrame:
    return v.files.select(
        "id",
        format_bytes("filesize").alias("shown"),
        mib("filesize").alias("size_mib"),
        gib("filesize").alias("size_gib"),
    )


def grade_items_kept_by_predicate(v: Views) -> DataFrame:
    kept = orphans.without(v.grade_items, F.col("itemtype") == "mod")
    return kept.select("id", "itemtype")


def _stored(v: Views, rows: DataFrame, label: str, by: tuple[str, ...] = ()) -> tuple[Staging, str]:
    """The rows as a table of files, as an application would keep them, and where it lies."""
    staging = Staging(v.spark)
    staging.keep(rows, label, by)
    return staging, f"{staging.folder}/{label}"


def _stored_log(v: Views) -> tuple[Staging, str]:
    return _stored(v, v.log.repartitionByRange(16, "timecreated"), "log")


def _log_vectors(v: Views, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.read_files(v.spark, folder, v.log.schema)
    doomed = orphans.log_rows_to_remove(rows, v.context, views.LOG_CUTOFF)
    return rows, vectors.deletion_vectors(rows, doomed)


def log_survivors_by_vectors(v: Views) -> DataFrame:
    staging, folder = _stored_log(v)
    rows, found = _log_vectors(v, folder)
    return vectors.survivors_by_position(rows, staging.keep(found, "vectors"))


def log_survivors_after_rewrite(v: Views) -> DataFrame:
    staging, folder = _stored_log(v)
    _, found = _log_vectors(v, folder)
    version = vectors.delete_rows(
        v.spark, folder, v.log.schema, found, staging.folder, rewrite_above=0.5
    )
    return version.read()


def files_rewrite_manifest(v: Views) -> DataFrame:
    """What happens to the file of each component when those past their lifetime go."""
    staging, folder = _stored(v, v.files.repartition("component"), "files", ("component",))
    rows = vectors.read_files(v.spark, folder, v.files.schema)
    cutoff = POLICY.cutoff(A, POLICY.component_file_days)
    found = vectors.deletion_vectors(rows, orphans.component_retention(rows, COMPONENTS, cutoff))
    version = vectors.delete_rows(v.spark, folder, v.files.schema, found, staging.folder, ("component",))
    component = F.regexp_extract(vectors.FILE, "component=([^/]+)/", 1).alias("component")
    return version.manifest.select(component, "rows", "deleted", "action")


def log_survivors_by_footers(v: Views) -> DataFrame:
    staging, folder = _stored_log(v)
    args = (v.spark, folder, v.log.schema, "timecreated", views.LOG_CUTOFF, staging)
    return aged_files.aged_table(*args).kept_with_parent(v.context, "contextid").select(*v.log.columns)


def log_months_by_age(v: Views) -> DataFrame:
    """Folders of the log, one a month, that retention drops unread, leaves, or has to scan. The rows of a
    month are dealt over several files, so that no task holds a whole month."""
    month = F.date_format(F.timestamp_seconds("timecreated"), "yyyy-MM")
    rows = v.log.withColumn("month", month).repartitionByRange("timecreated", "id")
    staging, folder = _stored(v, rows, "log", ("month",))
    args = (v.spark, folder, v.log.schema, "timecreated", views.LOG_CUTOFF, staging)
    return aged_files.aged_table(*args, by_folder=True).summary()


def usage_from_rollup(v: Views) -> DataFrame:
    """The report after three batches of files, the logs, and the rows that retention removes; one
    batch comes twice, and batches are merged in between."""
    sums = rollup.Rollup(v.spark, f"{Staging(v.spark).folder}/rollup")
    cutoff = POLICY.cutoff(A, POLICY.component_file_days)
    for area in ("draft", "course", "content"):
        sums.add(f"files-{area}", rollup.file_partials(v.files.where(F.col("filearea") == area)))
    logs = {"logstore_standard_log": v.log, "logstore_lanalytics_log": v.analytics_log}
    sums.add("logs", *[rollup.history_partials(n, rows, "timecreated") for n, rows in logs.items()])
    sums.compact()
    sums.add("files-course", rollup.file_partials(v.files.where(F.col("filearea") == "course")))
    gone = orphans.component_retention(v.files, COMPONENTS, cutoff)
    sums.add("files-gone", rollup.file_partials(gone, gone=True))
    gone = logs_orphan_or_aged(v)
    sums.add("logs-gone", rollup.history_partials("logstore_standard_log", gone, "timecreated", gone=True))
    names = [name for name, _ in statistics.HISTORY_TABLES]
    return rollup.usage_statistics_from(sums, COMPONENTS, names, list(logs), A)


def _rules() -> list[fixpoint.ForeignKey]:
    key = fixpoint.ForeignKey
    return [
        key("course_modules", "course", {"course": "id"}),
        key("grade_items", "course", {"courseid": "id"}),
        key("grade_items", "course_modules", {"courseid": "course", "iteminstance": "instance"}, {"itemtype": "mod"}),
        key("context", "course_modules", {"instanceid": "id"}, {"contextlevel": 70}),
        key("files", "context", {"contextid": "id"}),
        key("grade_grades", "grade_items", {"itemid": "id"}),
        key("completion", "course_modules", {"coursemoduleid": "id"}),
        key("categories", "categories", {"parent": "id"}),
        key("grade_items", "categories", {"iteminstance": "id"}, {"itemtype": "manual"}),
        key("categories", "grade_items", {"itemid": "id"}),
    ]


def cascade_fixpoint(v: Views) -> DataFrame:
    """All rows that go with the courses of one kind, along keys that form cycles."""
    tables = {
        "course": v.course, "course_modules": v.course_modules, "grade_items": v.grade_items,
        "context": v.context, "files": v.files, "grade_grades": v.grade_grades,
        "completion": v.completion, "categories": v.category_tree,
    }
    seeds = {"course": v.user.where(F.col("firstname") == "BUILDING").select("id")}
    found = fixpoint.cascade_to_fixpoint(tables, _rules(), seeds, Staging(v.spark))
    parts = [
        rows.select(F.lit(table).alias("table"), F.col("id").cast("string").alias("id"), "depth", "rule")
        for table, rows in found.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_QUERIES: dict[str, Callable[[Views], DataFrame]] = {
    "cleanup_report": cleanup_report,
    "cleanup_doomed": cleanup_doomed,
    "cleanup_unlinks": cleanup_unlinks,
    "logs_orphan_or_aged": logs_orphan_or_aged,
    "analytics_logs_orphan_or_aged": analytics_logs_orphan_or_aged,
    "grade_items_deleted_courses": lambda v: orphans.grade_items_of_deleted_courses(
        v.grade_items, v.course
    ),
    "grade_items_deleted_modules": lambda v: orphans.grade_items_of_deleted_modules(
        v.grade_items, v.course_modules
    ),
    "grade_items_first_rule": grade_items_first_rule,
    "grade_grades_orphan_items": lambda v: orphans.grades_of_deleted_items(
        v.grade_grades, v.grade_items
    ),
    "grade_grades_deleted_users": lambda v: orphans.grades_of_deleted_users(
        v.grade_grades, v.grader
    ),
    "grade_categories_deleted_courses": lambda v: orphans.rows_of_deleted_courses(
        v.grade_categories, v.course
    ),
    "grade_outcomes_deleted_courses": lambda v: orphans.rows_of_deleted_courses(
        v.grade_outcomes, v.course
    ),
    "grade_outcomes_sparing_nulls": lambda v: orphans.rows_of_deleted_courses(
        v.grade_categories, v.course, null_fk="keep"
    ),
    "grade_history_orphan_or_aged": lambda v: orphans.grade_history_to_remove(
        v.grade_history, v.grade_items, views.HISTORY_CUTOFF
    ),
    "component_retention": component_retention,
    "course_modules_orphans": lambda v: modules.orphan_modules(v.course_modules, v.course),
    "stalled_tasks": lambda v: _stalled(v).select("id", "faildelay", "timestarted"),
    "stalled_task_modules": _task_modules,
    "stalled_task_resolution": lambda v: modules.task_outcomes(_task_modules(v)),
    "module_cascade_context": _cascade("context", "context"),
    "module_cascade_files": _cascade("files", "files"),
    "module_cascade_events": _cascade("event", "event"),
    "module_cascade_grade_items": _cascade("grade_items", "grade_items"),
    "module_cascade_completion": _cascade("course_modules_completion", "completion"),
    "module_cascade_viewed": _cascade("course_modules_viewed", "viewed"),
    "module_cascade_criteria": _cascade("course_completion_criteria", "criteria"),
    "module_tags": _cascade_by(modules.tag_cascade()[1], "tags"),
    "module_content_tags": _cascade_by(modules.tag_cascade()[0], "tags"),
    "module_rows_by_context": _cascade_by(modules.by_module_context("tags"), "tags"),
    "module_rows_by_module": _cascade_by(modules.by_module("tags", "itemid"), "tags"),
    "stalled_tasks_with_sections": stalled_tasks_with_sections,
    "sections_after_cleanup": sections_after_cleanup,
    "module_tombstones": module_tombstones,
    "requeue_tasks": lambda v: modules.requeue_tasks(v.course_modules, 2, POLICY),
    "requeue_tasks_in_blocks": lambda v: modules.requeue_tasks(
        v.course_modules, 2, POLICY, block=3
    ),
    "tasks_after_requeue": lambda v: modules.without_requeued(v.task, POLICY).select(
        "id", "classname"
    ),
    "scan_ghosts": scan_ghosts,
    "ghost_scan_bytes": lambda v: ghosts.ghost_bytes(scan_ghosts(v)),
    "upsert_registry": upsert_registry,
    "registry_in_buckets": registry_in_buckets,
    "task_payloads": lambda v: listed_modules(v.task),
    "find_files_page_by_ranges": find_files_page_by_ranges,
    "cleanup_own_rules": cleanup_own_rules,
    "stored_bytes": stored_bytes,
    "registry_presence": lambda v: ghosts.registry_presence(v.registry, v.disk),
    "requeued_task_table": lambda v: requeued_tasks(v.task, v.course_modules, 2, POLICY),
    "ghosts_still_unlinked": lambda v: ghosts.still_unlinked(v.registry, v.files),
    "ghost_report_page0": lambda v: ghosts.ghost_report(v.registry),
    "ghost_totals": lambda v: ghosts.ghost_totals(v.registry),
    "ghost_downloads": lambda v: links.stored_download(v.registry, "/data"),
    "sniff_mime": sniff_mime,
    "content_presence": lambda v: checkout.with_presence(
        v.files.select("id", "contenthash"), v.disk
    ),
    "files_checkout": lambda v: checkout.files_checkout(*_checkout_args(v)),
    "files_checkout_safe": lambda v: checkout.files_checkout(*_checkout_args(v), True),
    "checkout_doomed": lambda v: checkout.checkout_doomed(*_checkout_args(v)),
    "checkout_unlinks": lambda v: checkout.unlink_hashes(*_checkout_args(v)),
    "checkout_unlinks_safe": lambda v: checkout.unlink_hashes(*_checkout_args(v), True),
    "remove_by_file": lambda v: removal.remove_by_file(v.files, _chosen(v)).select(
        "id", "contenthash", "filename"
    ),
    "removal_summary": lambda v: removal.removal_summary(v.files, v.disk, _chosen(v)),
    "resolve_links": lambda v: links.resolve_links(v.files, v.context, v.course_modules),
    "find_files_50mb": lambda v: search.find_files(v.files, v.user, FileFilter(min_mib=50)),
    "find_files_50mb_page1": lambda v: search.find_files(
        v.files, v.user, FileFilter(min_mib=50), limit=20, offset=20
    ),
    "find_files_user": find_files_user,
    "file_page_listing": lambda v: search.file_page(v.files, v.user)[0],
    "find_files_listing": find_files_listing,
    "count_files_50mb": lambda v: search.count_files(v.files, v.user, FileFilter(min_mib=50)),
    "count_files_user": lambda v: search.count_files(
        v.files, v.user, FileFilter(user_like="MACH")
    ),
    "file_stats_by_component": lambda v: statistics.file_stats(v.files, None, A),
    "component_stats_year_before": component_stats_year_before,
    "history_stats": history_stats,
    "grade_history_stats": grade_history_stats,
    "usage_statistics": usage_statistics,
    "apply_deletes_survivors": apply_deletes_survivors,
    "usage_from_rollup": usage_from_rollup,
    "cascade_fixpoint": cascade_fixpoint,
    "log_survivors_by_vectors": log_survivors_by_vectors,
    "log_survivors_after_rewrite": log_survivors_after_rewrite,
    "files_rewrite_manifest": files_rewrite_manifest,
    "log_survivors_by_footers": log_survivors_by_footers,
    "log_months_by_age": log_months_by_age,
    "delete_by_predicate_survivors": grade_items_kept_by_predicate,
    "drafts_past_lifetime": lambda v: v.files.where(
        (F.col("filearea") == "draft")
        & older_than("timecreated", POLICY.cutoff(A, POLICY.draft_days), inclusive=True)
    ).select("id", "timecreated"),
    "file_sizes": files_sizes,
    "cleanup_report_checkout_only": cleanup_report_checkout_only,
    "find_files_after_hash": lambda v: search.find_files(
        v.files, v.user, FileFilter(min_mib=10), after_hash="8"
    ),
    "ghost_report_after": lambda v: ghosts.ghost_report(
        ghosts.registry_rows(scan_ghosts(v).withColumn("mime", F.lit("text/plain"))),
        after=(1500, "filedir/8"),
    ),
    "backups_past_lifetime": lambda v: v.files.where(
        is_backup_name()
        & older_than("timecreated", POLICY.cutoff(A, POLICY.backup_days), inclusive=True)
    ).select("id", "filename", "timecreated"),
    "component_stats_last_year": lambda v: statistics.component_stats(
        v.files, "assignsubmission_file", until=years_before(A, 1), newer=True
    ),
    "component_stats_older": lambda v: statistics.component_stats(
        v.files, "assignsubmission_file", until=years_before(A, 1)
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, folder: query(Views(spark, folder))

    return {name: bind(query) for name, query in _QUERIES.items()}
