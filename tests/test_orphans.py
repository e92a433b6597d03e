import pytest

from cleanlake.operators import orphans


def test_null_foreign_key_is_doomed_or_kept(table, ids):
    items = table("grade_categories", [(1, 10), (2, 11), (3, None)])
    course = table("course", [(10,), (10,)])
    assert ids(orphans.orphans(items, course, "courseid")) == [2, 3]
    assert ids(orphans.orphans(items, course, "courseid", null_fk="keep")) == [2]
    with pytest.raises(ValueError):
        orphans.orphans(items, course, "courseid", null_fk="other")


def test_empty_sides(table, ids):
    rows = table("grade_categories", [(1, 10), (2, None)])
    none = table("course", [])
    assert ids(orphans.orphans(rows, none, "courseid")) == [1, 2]
    assert ids(orphans.orphans(table("grade_categories", []), none, "courseid")) == []


def test_duplicate_parents_do_not_multiply(table, ids):
    items = table("grade_items", [(1, 5, "mod", "quiz", 7), (2, 5, "mod", "quiz", 8)])
    cm = table("course_modules", [(i, 5, 1, 7, 1, 0) for i in range(3)])
    assert ids(orphans.grade_items_of_deleted_modules(items, cm)) == [2]


def test_module_items_ignore_type_of_module_and_other_items(table, ids):
    cm = table("course_modules", [(1, 5, 99, 7, 1, 0)])
    items = table(
        "grade_items",
        [
            (1, 5, "mod", "anything", 7),
            (2, 5, "manual", None, None),
            (3, None, "mod", "quiz", 7),
            (4, 5, "mod", "quiz", None),
        ],
    )
    assert ids(orphans.grade_items_of_deleted_modules(items, cm)) == [3, 4]


def test_orphan_or_aged_arms_are_disjoint_and_complete(table):
    log = table(
        "logstore_standard_log",
        [(1, 1, 99), (2, 1, 100), (3, 9, 99), (4, 9, 100), (5, None, 100), (6, 1, None), (7, 9, None)],
    )
    context = table("context", [(1, 70, 1)])
    doomed = orphans.log_rows_to_remove(log, context, 100)
    got = sorted((r.id, r.reason) for r in doomed.collect())
    assert got == [(1, "aged"), (3, "aged"), (4, "orphan"), (5, "orphan"), (7, "orphan")]


def test_users_flagged_deleted_still_count_as_present(table, ids):
    grades = table("grade_grades", [(1, 1, 1), (2, 1, 2), (3, 1, None)])
    users = table("user", [(1, "a", "b", 1)])
    assert ids(orphans.grades_of_deleted_users(grades, users)) == [2, 3]


def test_component_retention_is_strict(table, ids):
    def file(i, component, created):
        return (i, "h", 1, component, "content", 0, "/", "f", 1, 1, "x", created, 0)

    files = table("files", [file(1, "backup", 9), file(2, "backup", 10), file(3, "user", 1)])
    assert ids(orphans.component_retention(files, ["backup"], 10)) == [1]


def test_first_rule_wins(spark):
    a = spark.createDataFrame([(1, 5), (2, 5)], "id bigint, bytes bigint")
    b = spark.createDataFrame([(2, 5), (3, 5), (3, 5)], "id bigint, bytes bigint")
    got = orphans.first_rule([("late_name", a), ("early_name", b)]).collect()
    assert sorted((r.id, r.rule, r.bytes) for r in got) == [
        (1, "late_name", 5),
        (2, "late_name", 5),
        (3, "early_name", 5),
    ]


def test_survivors_and_doomed_split_the_table(table, ids):
    log = table("logstore_standard_log", [(i, i % 3, 100) for i in range(30)])
    doomed = orphans.log_rows_to_remove(log, table("context", [(1, 70, 1)]), 50)
    kept = orphans.survivors(log, doomed)
    assert sorted(ids(kept) + ids(doomed)) == list(range(30))
    assert kept.columns == log.columns


def test_delete_by_predicate_keeps_unknown(table, ids):
    from pyspark.sql import functions as F

    items = table("grade_items", [(1, 1, "mod", None, 1), (2, 1, None, None, 1), (3, 1, "x", None, 1)])
    assert ids(orphans.without(items, F.col("itemtype") == "mod")) == [2, 3]
