"""Queue pending module deletions anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.operators import modules
from cleanlake.operators.numbering import numbered
from cleanlake.operators.orphans import unwritten
from cleanlake.plans.staging import Staging
from cleanlake.policy import RetentionPolicy


def requeued_tasks(
    tasks: DataFrame,
    course_modules: DataFrame,
    user_id: int,
    policy: RetentionPolicy = RetentionPolicy(),
    block: int | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = unwritten,
) -> DataFrame:
    """The task table with old module deletions dropped and new ones appended.

    Numbering reads the new tasks twice; ``keep`` may write them.
    """
    new = keep(modules.requeue_tasks(course_modules, user_id, policy, block), "new-tasks")
    fresh = numbered(new, "customdata", tasks).select(
        "id",
        "classname",
        F.lit(0).cast("bigint").alias("faildelay"),
        F.lit(None).cast("bigint").alias("timestarted"),
        "customdata",
    )
    return modules.without_requeued(tasks, policy).unionByName(fresh)


def run_requeue(
    spark: SparkSession,
    tasks: DataFrame,
    course_modules: DataFrame,
    user_id: int,
    target: str,
    policy: RetentionPolicy = RetentionPolicy(),
    block: int | None = None,
) -> DataFrame:
    """Write the new version of the task table below ``target`` and return it."""
    with Staging(spark) as scratch:
        table = requeued_tasks(tasks, course_modules, user_id, policy, block, scratch.keep)
        return Staging(spark, target).keep(table, "table-task_adhoc")
