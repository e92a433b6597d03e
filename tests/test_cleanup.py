import os
from dataclasses import replace

import pytest

from cleanlake.operators import checkout
from cleanlake.plans.cleanup import (
    CheckoutStep,
    GhostsStep,
    GradesStep,
    LogsStep,
    apply_cleanup,
    cleanup_report,
    default_steps,
    plan_cleanup,
)
from cleanlake.plans.rules import Rule, in_order
from cleanlake.plans.staging import ResumableStaging, Staging
from cleanlake.policy import DAY, MODULE_DELETE_TASK, RetentionPolicy

AS_OF = 2_000 * DAY
NEW = AS_OF - DAY
POLICY = RetentionPolicy(auto_remove=True)


def file(i, content, context=1, component="user", name="a.pdf", area="content", days_old=1):
    created = AS_OF - days_old * DAY
    return (i, content, context, component, area, 0, "/", name, 10, 1, "x", created, created)


@pytest.fixture
def data(table):
    """Course 10 is there, course 11 is gone. Module 1 stays, 2 and 3 go, 4 has no known type."""
    return {
        "course": table("course", [(10,)]),
        "modules": table("modules", [(1, "quiz")]),
        "course_modules": table(
            "course_modules",
            [(1, 10, 1, 100, 1, 0), (2, 11, 1, 200, 1, 0), (3, 10, 1, 300, 1, 1), (4, 11, 9, 400, 1, 0)],
        ),
        "context": table("context", [(51, 70, 1), (52, 70, 2), (53, 70, 3), (60, 50, 10)]),
        "user": table("user", [(1, "a", "b", 0)]),
        "grade_items": table(
            "grade_items",
            [
                (1, 10, "mod", "quiz", 100),  # stays
                (2, 11, "mod", "quiz", 200),  # cascades from module 2
                (3, 10, "mod", "quiz", 300),  # cascades from module 3
                (4, 11, "course", None, None),  # course gone
                (5, 10, "mod", "forum", 300),  # orphan only once module 3 has gone
                (6, None, "course", None, None),  # never had a course
            ],
        ),
        "grade_grades": table(
            "grade_grades", [(1, 1, 1), (2, 3, 1), (3, 5, 1), (4, 1, 9), (5, 6, 1), (6, 9, 9)]
        ),
        "grade_categories": table("grade_categories", [(1, 10), (2, 11), (3, None)]),
        "grade_grades_history": table(
            "grade_grades_history", [(1, 1, NEW), (2, 3, NEW), (3, 1, AS_OF - 501 * DAY), (4, 6, NEW)]
        ),
        "logstore_standard_log": table(
            "logstore_standard_log",
            [(1, 51, NEW), (2, 53, NEW), (3, 60, NEW), (4, 51, AS_OF - 501 * DAY), (5, 99, NEW)],
        ),
        "task_adhoc": table(
            "task_adhoc",
            [
                (1, MODULE_DELETE_TASK, 1, 0, '{"cms":[{"id":"3"},{"id":"2"}]}'),
                (2, MODULE_DELETE_TASK, 1, 0, '{"cms":[{"id":"4"}]}'),
                (3, "other", 1, 0, "{}"),
            ],
        ),
        "files": table(
            "files",
            [
                file(1, "h1", 51),
                file(2, "h2", 53),  # cascades from module 3
                file(3, "h3", 51, "backup", days_old=181),  # component lifetime
                file(4, "h4", 51, "user", "b.mbz", days_old=31),  # outdated backup
                file(5, "h4", 51),  # loses its content to file 4
                file(6, "h5", 51, area="draft", days_old=31),  # lone outdated draft
                file(7, "nowhere", 51),  # content missing
                file(8, "h6", 51),  # content registered as a ghost, linked again
            ],
        ),
        "ghost_registry": table(
            "ghost_registry", [(1, "filedir/g1", "m", 7), (2, "filedir/h6", "m", 10)]
        ),
    }


@pytest.fixture
def inventory(table):
    names = ["h1", "h2", "h3", "h4", "h5", "h6", "g1"]
    return table("inventory", [(f"filedir/{h}", h, 10) for h in names])


def doomed(plan):
    return {
        t: {r.id: r.rule for r in rows.collect()} for t, rows in plan.doomed.items()
    }


EXPECTED = {
    "course_modules": {2: "deleted_course", 3: "stalled_task"},
    "task_adhoc": {1: "resolved_task"},
    "context": {52: "module_context", 53: "module_context"},
    "files": {
        2: "module_files",
        3: "backup",
        4: "backup",
        5: "content_gone",
        6: "draft",
        7: "missing",
    },
    "grade_items": {
        2: "module_grade_items",
        3: "module_grade_items",
        4: "deleted_course",
        5: "deleted_module",
    },
    "grade_grades": {2: "deleted_item", 3: "deleted_item", 4: "deleted_user", 6: "deleted_item"},
    "grade_categories": {2: "deleted_course", 3: "deleted_course"},
    "grade_grades_history": {2: "deleted_item_or_aged", 3: "deleted_item_or_aged"},
    "logstore_standard_log": {i: "no_context_or_aged" for i in (2, 4, 5)},
    "ghost_registry": {1: "ghost", 2: "linked_again"},
}


def test_later_rules_see_what_earlier_ones_removed(spark, data, inventory):
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF)
    assert doomed(plan) == EXPECTED
    assert {(r.path, r.reason) for r in plan.unlinks.collect()} == {
        ("filedir/g1", "ghost"),
        ("filedir/h4", "backup"),
        ("filedir/h5", "draft"),
    }


def test_a_module_that_goes_with_its_course_does_not_fail_its_task(spark, data, inventory, table):
    # Modules 2 (course gone) and 3 are listed by no section; only 3 is still there for task 1.
    sections = table("course_sections", [(1, "1, 9"), (2, "7")])
    data["course_modules"] = table(
        "course_modules", [(1, 10, 1, 100, 1, 0), (2, 11, 1, 200, 1, 0), (3, 10, 1, 300, 1, 1)]
    )
    data["task_adhoc"] = table(
        "task_adhoc",
        [(i, MODULE_DELETE_TASK, 1, 0, f'{{"cms":[{{"id":"{m}"}}]}}') for i, m in ((1, 2), (2, 3))],
    )
    plan = plan_cleanup(spark, {**data, "course_sections": sections}, inventory, POLICY, AS_OF)
    got = doomed(plan)
    assert got["task_adhoc"] == {1: "resolved_task"}
    assert got["course_modules"] == {2: "deleted_course", 3: "stalled_task"}


def test_deleted_modules_leave_their_section(spark, data, inventory, table, tmp_path):
    sections = table("course_sections", [(1, "3,1, 2"), (2, "2"), (3, None)])
    plan = plan_cleanup(spark, {**data, "course_sections": sections}, inventory, POLICY, AS_OF)
    done = apply_cleanup(spark, plan, str(tmp_path / "out"), str(tmp_path), dry_run=False)
    lists = {r.id: r.sequence for r in done["course_sections"].collect()}
    assert lists == {1: "1", 2: "2", 3: None}, "module 2 belongs to section 1"


def test_a_closed_plan_leaves_no_tables(spark, data, inventory, tmp_path):
    plan = plan_cleanup(
        spark, data, inventory, POLICY, AS_OF, staging=Staging(spark, str(tmp_path / "stage"))
    )
    audit = plan.write(str(tmp_path / "audit"))
    plan.close()
    assert not os.listdir(tmp_path / "stage")
    assert doomed(audit) == EXPECTED


def test_scans_of_the_files(spark, data, inventory, tmp_path, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    data["files"].write.parquet(str(tmp_path / "files"))
    data["files"] = spark.read.parquet(str(tmp_path / "files"))
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF)
    final = plan.doomed["files"]._jdf.queryExecution().executedPlan().toString()
    assert final.count(str(tmp_path / "files")) <= 1, "written steps are read, not worked out again"


def test_without_recheck_linked_ghosts_lose_their_content(spark, data, inventory):
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF, recheck_ghosts=False)
    got = doomed(plan)
    assert got["ghost_registry"] == {1: "ghost", 2: "ghost"}
    assert got["files"][8] == "missing"


def test_only_the_checkout_runs_unless_auto_remove_is_on(spark, data, inventory):
    plan = plan_cleanup(spark, data, inventory, RetentionPolicy(), AS_OF)
    assert doomed(plan) == {
        "files": {4: "backup", 5: "content_gone", 6: "draft", 7: "missing"}
    }


def test_report_lists_every_rule(spark, data, inventory):
    data = {k: v for k, v in data.items() if k != "task_adhoc"}
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF)
    report = {
        (r.step, r.table, r.rule): (r.rows, r.bytes, r.status)
        for r in cleanup_report(spark, plan).collect()
    }
    assert report["logs", "logstore_lanalytics_log", "no_context_or_aged"] == (0, 0, "skipped")
    assert report["component_files", "files", "assignsubmission_file"] == (0, 0, "none")
    assert report["component_files", "files", "backup"] == (1, 10, "ok")
    assert report["files_checkout", "files", "backup"] == (1, 10, "ok")
    assert report["ghost_files", "ghost_registry", "ghost"] == (1, 7, "ok")
    assert ("course_modules", "task_adhoc", "resolved_task") not in report
    assert len(report) == len(plan.catalog)


def test_own_rules_and_chosen_steps(spark, data, inventory):
    rule = Rule("no_user", "files", lambda run: run.live("files").where("contextid = 53"), "filesize")
    absent = Rule("nothing", "no_table", lambda run: run.live("no_table"))
    plan = plan_cleanup(
        spark, data, inventory, POLICY, AS_OF, steps=[rule, absent, LogsStep(), CheckoutStep()]
    )
    got = doomed(plan)
    assert got["files"][2] == "no_user"
    assert set(got["logstore_standard_log"]) == {4, 5}
    status = {r.rule: r.status for r in cleanup_report(spark, plan).collect()}
    assert status["nothing"] == "skipped"


def test_survivors_complement_the_doomed_and_a_second_run_finds_nothing(
    spark, data, inventory, table, tmp_path
):
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF).write(str(tmp_path / "audit"))
    dry = apply_cleanup(spark, plan, str(tmp_path / "dry"), str(tmp_path))
    assert set(dry) == {"unlinked", "tombstones"}, "a dry run writes no tables"
    assert {r.status for r in dry["unlinked"].collect()} == {"planned"}
    data["files"] = data["files"].unionByName(
        table("files", [file(20, "h1", 51, "mod_page"), file(21, "h1", 51, "mod_page")])
    )
    done = apply_cleanup(
        spark, replace(plan, tables=data), str(tmp_path / "out"), str(tmp_path), dry_run=False,
        partition_by={"files": ["component"]},
    )
    assert {r.status for r in done["unlinked"].collect()} == {"absent"}
    expected = {*EXPECTED, "unlinked", "tombstones", "touched-files"}
    assert set(done) == expected, "modules and others are not copied"
    parts = {r.component for r in done["files"].select("component").distinct().collect()}
    assert "mod_page" not in parts, "partitions that lose nothing are not copied"
    done["files"] = done["files"].unionByName(data["files"].where("component = 'mod_page'"))
    for name, gone in EXPECTED.items():
        kept = {r[0] for r in done[name].select("id").collect()}
        before = {r[0] for r in data[name].select("id").collect()}
        assert kept | set(gone) == before and not kept & set(gone)
        assert done[name].columns == data[name].columns
    assert sorted(r.objectid for r in done["tombstones"].collect()) == [2, 3]
    unlinked = plan.unlinks.select("path")
    again = plan_cleanup(
        spark,
        {**data, **done},
        inventory.join(unlinked, "path", "left_anti"),
        POLICY,
        AS_OF,
    )
    assert {t: rows for t, rows in doomed(again).items() if rows} == {}


def test_an_emptied_partition_is_named(spark, data, inventory, tmp_path):
    """Component backup loses its only file: it is among the touched, and has no folder."""
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF)
    done = apply_cleanup(
        spark, plan, str(tmp_path / "out"), str(tmp_path), dry_run=False, partition_by={"files": ["component"]}
    )
    before = {r[0] for r in data["files"].select("component").distinct().collect()}
    touched = {r[0] for r in done["touched-files"].collect()}
    written = {r[0] for r in done["files"].select("component").distinct().collect()}
    assert "backup" in before & touched and "backup" not in written
    # Swapped in as the docstring says, the table is the survivors.
    left = data["files"].join(done["touched-files"], "component", "left_anti").select("id")
    found = {r[0] for r in left.union(done["files"].select("id")).collect()}
    assert found == {r[0] for r in data["files"].select("id").collect()} - set(EXPECTED["files"])


def test_located_tables_are_written_by_file(spark, data, inventory, tmp_path):
    """Grades lie in one file each: those that lose theirs go, no other is written."""
    place = str(tmp_path / "grades")
    data["grade_grades"].repartitionByRange(6, "id").write.parquet(place)
    data["grade_grades"] = spark.read.parquet(place)
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF)
    done = apply_cleanup(
        spark, plan, str(tmp_path / "out"), str(tmp_path), dry_run=False, located={"grade_grades": place}
    )
    assert {r[0] for r in done["grade_grades"].select("id").collect()} == {1, 5}
    rows = {"kept": 0, "dropped": 0, "rewritten": 0}
    for r in done["manifest-grade_grades"].collect():
        rows[r["action"]] += r["rows"] - r["deleted"]
    assert sum(rows.values()) == 2 and rows["dropped"] == 0
    assert spark.read.parquet(place).count() == 6


def test_applying_unlinks_files_and_keeps_records_of_stuck_ones(spark, data, inventory, tmp_path):
    root = tmp_path / "data"
    (root / "filedir").mkdir(parents=True)
    for name in ("h1", "h2", "h3", "h5", "h6", "g1"):
        (root / "filedir" / name).write_bytes(b"x")
    (root / "filedir" / "h4").mkdir()  # a directory cannot be unlinked as a file
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF)
    done = apply_cleanup(spark, plan, str(tmp_path / "out"), str(root), dry_run=False)
    assert {r.path: r.status for r in done["unlinked"].collect()} == {
        "filedir/g1": "removed",
        "filedir/h4": "error",
        "filedir/h5": "removed",
    }
    assert sorted(os.listdir(root / "filedir")) == ["h1", "h2", "h3", "h4", "h6"]
    # Files 4 and 5 share the stuck content.
    assert sorted(r.id for r in done["files"].select("id").collect()) == [1, 4, 5, 8]


def test_actions_are_all_reported():
    assert set(CheckoutStep.actions) == {
        checkout.MISSING, checkout.GONE, checkout.BACKUP, checkout.DRAFT,
    }


class Stop:
    """Breaks the plan off."""

    name = "stop"

    def plan(self, run):
        raise KeyboardInterrupt("the driver is gone")


def test_a_plan_that_was_broken_off_goes_on(spark, data, inventory, tmp_path):
    """Stopped behind each step in turn, then made again: the same report, and nothing done twice."""
    rows = lambda plan: [tuple(r) for r in cleanup_report(spark, plan).orderBy("seq").collect()]
    want = rows(plan_cleanup(spark, data, inventory, POLICY, AS_OF))
    job = {"as_of": str(AS_OF), "policy": repr(POLICY)}
    steps = default_steps(POLICY)
    done = set()
    for at in range(1, len(steps) + 1):
        staging = ResumableStaging(spark, str(tmp_path), "nightly", job)
        with pytest.raises(KeyboardInterrupt):
            plan_cleanup(spark, data, inventory, POLICY, AS_OF, [*steps[:at], Stop()], staging)
        assert staging.made and not done & set(staging.made)
        done |= set(staging.made)
    staging = ResumableStaging(spark, str(tmp_path), "nightly", job)
    plan = plan_cleanup(spark, data, inventory, POLICY, AS_OF, staging=staging)
    assert staging.made == [] and rows(plan) == want
    # A table that was not finished is made again.
    broken = sorted(done)[0]
    os.remove(f"{staging.folder}/{broken}/_SUCCESS")
    staging = ResumableStaging(spark, str(tmp_path), "nightly", job)
    assert rows(plan_cleanup(spark, data, inventory, POLICY, AS_OF, staging=staging)) == want
    assert staging.made == [broken]
    with pytest.raises(ValueError):
        ResumableStaging(spark, str(tmp_path), "nightly", job | {"as_of": "0"})
    staging.close()
    assert not os.path.exists(staging.folder)


def test_steps_that_do_not_wait_run_side_by_side():
    """Each of two steps ends only when the other has begun; a third one waits for both."""
    from threading import Barrier
    from types import SimpleNamespace

    both, seen = Barrier(2, timeout=20), []

    def step(name, after, work):
        own = SimpleNamespace(name=name, plan=lambda run: (work(), run.catalog.append((name, "", "", ""))))
        if after is not None:
            own.after = after
        return own

    steps = [
        step("first", None, lambda: seen.append("first")),
        step("left", ("first",), both.wait),
        step("right", ("first",), both.wait),
        step("last", None, lambda: seen.append("last")),
    ]
    run = SimpleNamespace(catalog=[], staging=SimpleNamespace(spark=None))
    in_order(steps, run)
    assert [name for name, *_ in run.catalog] == ["first", "left", "right", "last"]
    assert seen == ["first", "last"]
    assert set(GradesStep.after) == set(LogsStep.after) < set(GhostsStep.after)
