import json

import pytest
from pyspark.sql import functions as F

from cleanlake.operators import modules as m
from cleanlake.plans.requeue import run_requeue
from cleanlake.policy import DAY, MODULE_DELETE_TASK, RetentionPolicy

AS_OF = 1_000 * DAY
CUT = AS_OF - 7 * DAY


def task(i, payload="{}", started=0, delay=1, name=MODULE_DELETE_TASK):
    return (i, name, delay, started, payload)


@pytest.fixture
def cm(table):
    # id, course, module, instance, section, deletioninprogress
    return table(
        "course_modules",
        [(1, 10, 1, 100, 5, 0), (2, 10, 2, 200, 5, 1), (3, 11, 9, 300, 6, 1), (4, 11, 1, 400, 6, 1)],
    )


@pytest.fixture
def types(table):
    return table("modules", [(1, "quiz"), (2, "forum")])


def test_stalled_tasks(table, ids):
    tasks = table(
        "task_adhoc",
        [task(1, started=CUT - 1), task(2, started=CUT), task(3, started=None),
         task(4, delay=0), task(5, name="other")],
    )
    assert ids(m.stalled_tasks(tasks, RetentionPolicy(), AS_OF)) == [1]


def test_outcomes_decide_whether_a_task_goes(table, cm, types):
    tasks = table(
        "task_adhoc",
        [
            task(1, '{"cms":[{"id":"1"},{"id":"99"}]}'),
            task(2, '{"cms":{"3":{"id":"3"},"1":{"id":"1"}}}'),
            task(3, '{"cms":[]}'),
            task(4, "garbage"),
            task(5, '{"cms":[{"id":"2"}]}'),
        ],
    )
    listed = m.stalled_task_modules(tasks, cm, types, undeletable=["forum"])
    got = {(r.task_id, r.module_id): r.outcome for r in listed.collect()}
    assert got == {
        (1, 1): "deleted",
        (1, 99): "absent",
        (2, 3): "failed",
        (2, 1): "deleted",
        (3, None): None,
        (4, None): None,
        (5, 2): "left_in_place",
    }
    tasks = {r.task_id: (r.n_modules, r.n_failed, r.removed) for r in m.task_outcomes(listed).collect()}
    assert tasks == {
        1: (2, 0, True), 2: (2, 1, False), 3: (0, 0, True), 4: (0, 0, True), 5: (1, 0, True),
    }


def test_module_missing_from_its_section_fails_the_task(table, cm, types):
    sections = table("course_sections", [(5, "1,7"), (6, "3, 4")])
    tasks = table("task_adhoc", [task(1, '{"cms":[{"id":1},{"id":2},{"id":4}]}')])
    listed = m.stalled_task_modules(tasks, cm, types, sections=sections)
    assert {r.module_id: r.outcome for r in listed.collect()} == {
        1: "deleted",
        2: "unlisted",
        4: "deleted",
    }
    assert not m.task_outcomes(listed).first().removed


def test_doomed_modules_have_names_and_contexts(table, cm, types):
    context = table("context", [(50, 70, 1), (51, 50, 2)])
    got = {r.id: (r.module_name, r.component, r.contextid) for r in m.doomed_modules(cm, types, context).collect()}
    assert got == {
        1: ("quiz", "mod_quiz", 50),
        2: ("forum", "mod_forum", None),
        4: ("quiz", "mod_quiz", None),
    }


def test_cascade_matches_all_keys(spark, table, cm, types, ids):
    context = table("context", [(50, 70, 1), (51, 50, 1), (52, 70, 3)])
    doomed = m.doomed_modules(cm.where("id < 3"), types, context)
    tables = {
        "context": context,
        "event": table("event", [(1, 100, "quiz"), (2, 100, "forum"), (3, 200, "forum")]),
        "grade_items": table(
            "grade_items",
            [(1, 10, "mod", "quiz", 100), (2, 10, "manual", "quiz", 100),
             (3, 11, "mod", "quiz", 100), (4, 10, "mod", "forum", 100)],
        ),
        "course_modules_completion": table("course_modules_completion", [(1, 1), (2, 2), (3, 3)]),
        "course_completion_criteria": table(
            "course_completion_criteria", [(1, 1, 10, 4), (2, 1, 10, 5), (3, 1, 11, 4)]
        ),
        "tag_instance": spark.createDataFrame(
            [(1, "mod_quiz", "x", 7, 50), (2, "mod_quiz", "x", 7, 99),
             (3, "core", "course_modules", 2, None), (4, "core", "course_modules", 9, None)],
            "id bigint, component string, itemtype string, itemid bigint, contextid bigint",
        ),
        "blog": spark.createDataFrame([(1, 50), (2, 51)], "id bigint, contextid bigint"),
        "skills": spark.createDataFrame([(1, 1), (2, 3)], "id bigint, cmid bigint"),
    }
    rules = (
        *m.module_cascade(),
        *m.tag_cascade(),
        m.by_module_context("blog"),
        m.by_module("skills", "cmid"),
    )
    got = {label: ids(rows) for label, rows in m.cascade(doomed, tables, rules).items()}
    assert got == {
        "module_context": [50],
        "module_event": [1, 3],
        "module_grade_items": [1],
        "module_course_modules_completion": [1, 2],
        "module_course_completion_criteria": [1],
        "module_content_tags": [1],
        "module_tags": [3],
        "module_blog": [1],
        "module_skills": [1],
    }


def test_sections_lose_the_doomed_modules(table, cm):
    sections = table("course_sections", [(5, "2,1,8"), (6, "3,4"), (7, "1"), (8, None)])
    got = m.remove_from_sections(sections, cm.where("id in (1, 3, 4)")).collect()
    assert {r.id: r.sequence for r in got} == {5: "2,8", 6: ""}


def test_tombstones_snapshot_the_row(table, cm, types):
    context = table("context", [(50, 70, 1)])
    stones = m.module_tombstones(m.doomed_modules(cm.where("id = 1"), types, context), cm)
    row = stones.first()
    assert tuple(row)[:5] == (10, 50, 1, "quiz", 100)
    assert row.snapshot.asDict() == cm.where("id = 1").first().asDict()


def test_one_new_task_per_course(cm):
    rows = {r.course: r for r in m.requeue_tasks(cm, 2).collect()}
    assert {c: r.n_modules for c, r in rows.items()} == {10: 1, 11: 2}
    assert json.loads(rows[11].customdata) == {
        "cms": {"3": {"id": "3"}, "4": {"id": "4"}},
        "userid": "2",
        "realuserid": "2",
    }
    assert rows[10].classname == MODULE_DELETE_TASK


def test_a_course_has_one_task_unless_blocks_are_asked_for(spark):
    ids = F.col("id")
    course = F.when(ids % 3 == 0, 7).otherwise(ids % 50)
    cm = spark.range(5000).select("id", course.alias("course"), F.lit(1).alias("deletioninprogress"))
    one = m.requeue_tasks(cm, 2).collect()
    assert len(one) == len({t.course for t in one}) and max(t.n_modules for t in one) > 1666
    blocks = m.requeue_tasks(cm, 2, block=100).collect()
    assert max(t.n_modules for t in blocks) <= 100
    for tasks in (one, blocks):
        listed = [int(i) for t in tasks for i in json.loads(t.customdata)["cms"]]
        assert sorted(listed) == list(range(5000))
    small = {b for r in cm.where("course = 3").collect() for b in [r.id // 100]}
    assert sum(t.course == 3 for t in blocks) == len(small), "small courses are cut alike"


def test_old_tasks_are_dropped_when_queued_anew(table, ids):
    tasks = table("task_adhoc", [task(1), task(2, name="other"), task(3, name=None)])
    assert ids(m.without_requeued(tasks)) == [2, 3]


def test_requeued_table_is_written_with_fresh_ids(spark, table, cm, tmp_path):
    tasks = table("task_adhoc", [task(1), task(7, name="other")])
    rows = run_requeue(spark, tasks, cm, 2, str(tmp_path)).collect()
    assert sorted(r.id for r in rows) == [7, 8, 9]
    fresh = [r for r in rows if r.id > 7]
    assert {(r.classname, r.faildelay, r.timestarted) for r in fresh} == {(MODULE_DELETE_TASK, 0, None)}
    listed = {i for r in fresh for i in json.loads(r.customdata)["cms"]}
    assert listed == {"2", "3", "4"}
