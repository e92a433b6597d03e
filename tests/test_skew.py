"""Hot keys are left to adaptive execution, and building a frame starts no job."""

import pytest
from pyspark.sql import functions as F

from cleanlake.demo import queries as demo
from cleanlake.operators import checkout, modules, orphans
from cleanlake.plans.staging import Staging, checkpoint_folder
from cleanlake.policy import DAY, RetentionPolicy

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    "spark.sql.shuffle.partitions": "16",
}


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def hot(spark, column, key=7):
    """A third of the rows have one key."""
    value = F.when(F.col("id") % 3 == 0, key).otherwise(F.col("id"))
    return spark.range(0, 400_000, 1, 8).withColumn(column, value)


def test_a_hot_foreign_key_is_split(spark, conf):
    conf(CONF)
    log = hot(spark, "contextid").withColumn("timecreated", F.lit(100).cast("bigint"))
    lost = orphans.orphans(log, spark.range(1, 300_000, 1, 8), "contextid").select("id")
    assert "skew=true" in plan_of(lost)


def test_a_hot_cascade_key_is_split(spark, conf, tmp_path):
    conf(CONF)
    rows = hot(spark, "coursemoduleid")
    doomed = spark.range(0, 300_000, 1, 8)
    keep = Staging(spark, str(tmp_path)).keep
    rule = modules.CascadeRule("t", {"coursemoduleid": "id"})
    gone = modules.cascade_rows(doomed, rows, rule, keep).select("id")
    assert "skew=true" in plan_of(gone)
    assert gone.count() == modules.cascade_rows(doomed, rows, rule).count()


def test_a_hot_content_is_split_in_the_checkout(spark, conf, tmp_path):
    conf(CONF)
    files = hot(spark, "c").select(
        "id", F.col("c").cast("string").alias("contenthash"), F.lit("a.mbz").alias("filename"),
        F.lit("user").alias("component"), F.lit("draft").alias("filearea"),
        F.lit(0).cast("bigint").alias("timecreated"), F.lit(1).cast("bigint").alias("filesize"),
    )
    listing = spark.range(0, 300_000, 1, 8).select(F.col("id").cast("string").alias("contenthash"))
    args = (files, listing, RetentionPolicy(), 1_000 * DAY)
    keep = Staging(spark, str(tmp_path)).keep
    doomed = checkout.checkout_doomed(*args, keep=keep).select("id")
    assert "skew=true" in plan_of(doomed)


# Plans write tables between their steps, table sizes are read, and links to them are made.
JOBS = {"cleanup_report", "cleanup_doomed", "cleanup_unlinks", "cleanup_report_checkout_only",
        "sections_after_cleanup"}


@pytest.mark.parametrize("name", sorted(set(demo.queries()) - JOBS))
def test_building_a_frame_starts_no_job(spark, name):
    spark.sparkContext.setJobGroup(name, name)
    demo.queries()[name](spark, "/root/testdata/sf0.001")
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    reads = 14  # a job for the schema of each table that is read
    assert len(started) <= reads


def test_the_shared_folder_must_be_known(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(RuntimeError):
        checkpoint_folder(spark)
