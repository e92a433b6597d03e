"""Sets of keys as bitmaps: the same rows as a join, and none of them shuffled."""

import pytest
from pyspark.sql import functions as F

from cleanlake.demo import queries as demo
from cleanlake.demo.views import Views
from cleanlake.operators import modules, orphans
from cleanlake.operators.key_sets import KeySet, key_set
from cleanlake.plans.staging import Staging

EDGES = [0, 1, -1, 32_767, 32_768, 32_769, -32_767, -32_768, -32_769, 65_536]


@pytest.fixture
def children(spark):
    return spark.range(-70_000, 70_000).withColumn("fk", F.when(F.col("id") % 1000 != 3, F.col("id")))


def test_the_same_rows_as_a_join(spark, children):
    few = spark.range(-66_000, 66_000, 7).select("id")
    keys = few.unionByName(spark.createDataFrame([(i,) for i in EDGES] + [(None,)], "id bigint")).distinct()
    found, plain = key_set(keys), keys.withColumnRenamed("id", "fk")
    for ours, how in ((found.having, "left_semi"), (found.lacking, "left_anti")):
        got = sorted(r.id for r in ours(children, "fk").collect())
        assert got == sorted(r.id for r in children.join(plain, "fk", how).collect())


def test_an_empty_set_has_nothing(spark, children):
    found = key_set(spark.createDataFrame([], "id bigint"))
    assert found.having(children, "fk").isEmpty()
    assert found.lacking(children, "fk").count() == 140_000


def test_keys_far_apart_or_of_text_stay_a_table(spark, conf):
    assert key_set(spark.range(1000).select((F.col("id") * 10**12).alias("id"))) is None
    assert key_set(spark.range(1000).select(F.col("id").cast("string").alias("id"))) is None
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    assert key_set(spark.range(1000)) is None


def test_rows_of_a_cascade_are_not_shuffled(spark, conf, tmp_path):
    conf({"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1k"})
    rows = spark.range(0, 100_000).withColumn("coursemoduleid", F.col("id") * 3)
    rule = modules.CascadeRule("t", {"coursemoduleid": "id"})
    gone = modules.cascade_rows(spark.range(0, 90_000), rows, rule, Staging(spark, str(tmp_path)).keep)
    assert gone.count() == 30_000
    assert "SortMergeJoin" not in gone._jdf.queryExecution().executedPlan().toString()


def test_grades_of_a_clean_up_are_not_shuffled(spark, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1k"})
    views = Views(spark, "/root/testdata/sf0.001")
    rows = demo._plan(views).doomed["grade_grades_history"]
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_ids_of_another_kind_are_joined(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "x")], "id string, fk string")
    rule = modules.CascadeRule("t", {"fk": "id"})
    keep = lambda frame, label: frame
    assert [r.id for r in modules.cascade_rows(spark.range(0, 3000), rows.where("fk = '1'"), rule, keep).collect()] == ["a"]


def test_orphans_take_a_set(spark, children):
    found = key_set(spark.range(0, 70_000))
    assert orphans.orphans(children, found, "fk").count() == 70_000 + 70
    assert orphans.orphans(children, found, "fk", null_fk="keep").count() == 70_000


def test_rows_are_read_once_for_all_parents(spark):
    """Null keys, repeated ids and rows that two rules doom come out as from the rules one by one."""
    child = spark.range(3_000).selectExpr(
        "cast(id - id % 50 div 49 as string) as id", "nullif(id % 400, 7) as a", "nullif(id % 350, 2) as b"
    )
    first, second = spark.range(1, 300), spark.range(5, 340)
    wanted = [("no_a", first, "a"), ("no_b", second, "b")]
    sets = [(name, key_set(parent), fk) for name, parent, fk in wanted]
    assert all(isinstance(parent, KeySet) for _, parent, _ in sets)
    got = orphans.first_parent_gone(child, sets)
    plain = orphans.first_parent_gone(child, wanted)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, plain.collect())) and len(rows) == len({r[0] for r in rows})
    assert {r[1] for r in rows} == {"no_a", "no_b"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3000") == 1
