"""The jobs from a command line: ``python -m cleanlake <job> --tables <location> ...``.

Run it by ``spark-submit`` or with a session's settings in the environment; tables are Parquet below one
location, and settings are the table ``config`` there, if there is one. Nothing is changed without
``--apply``, and new versions are written below ``--out``.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cleanlake.operators import statistics
from cleanlake.plans.cleanup import apply_cleanup, cleanup_report, plan_cleanup
from cleanlake.plans.requeue import run_requeue
from cleanlake.plans.scan import run_scan
from cleanlake.plans.staging import ResumableStaging, Staging
from cleanlake.policy import RetentionPolicy
from cleanlake.schemas import SCHEMAS
from cleanlake.session import configure
from cleanlake.sources.inventory import file_inventory
from cleanlake.sources.tables import path_exists, read_tables, stored_policy


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cleanlake", description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, out: bool = True, root: bool = False) -> argparse.ArgumentParser:
        own = jobs.add_parser(name, help=text, description=text)
        own.add_argument("--tables", required=True, help="location of the tables")
        own.add_argument("--as-of", type=int, help="epoch second that counts as now")
        if out:
            own.add_argument("--out", required=True, help="where results are written")
        if root:
            own.add_argument("--root", required=True, help="the storage tree")
        return own

    job("usage", "Files and bytes per component, rows per history table, by year.", out=False)
    requeue = job("requeue", "Queue pending module deletions anew.")
    requeue.add_argument("--user", type=int, default=2, help="id of the user who deletes")
    requeue.add_argument("--block", type=int, help="width of the blocks of ids that get a task each")
    cleanup = job("cleanup", "Plan a clean-up, write its audit, and show its report.", root=True)
    cleanup.add_argument("--apply", action="store_true", help="unlink files and write new tables")
    cleanup.add_argument("--resume", metavar="NAME", help="go on with the plan of this name")
    job("scan", "Find stored files without a record, and bring their registry up to date.", root=True)
    return parser


def _usage(spark: SparkSession, options, tables: dict[str, DataFrame], policy: RetentionPolicy) -> DataFrame:
    history = [
        statistics.HistoryTable(name, tables.get(name), ts) for name, ts in statistics.HISTORY_TABLES
    ]
    paths = {h.name: f"{options.tables}/{h.name}" for h in history if h.rows is not None}
    return statistics.usage_statistics(
        spark, tables["files"], policy.components, history, options.as_of, paths
    )


def _requeue(spark: SparkSession, options, tables: dict[str, DataFrame], policy: RetentionPolicy) -> DataFrame:
    table = run_requeue(
        spark, tables["task_adhoc"], tables["course_modules"], options.user, options.out, policy, options.block
    )
    return table.groupBy("classname").count()


def _cleanup(spark: SparkSession, options, tables: dict[str, DataFrame], policy: RetentionPolicy) -> DataFrame:
    staging = None
    if options.resume:
        job = {"tables": options.tables, "root": options.root, "as_of": str(options.as_of), "policy": repr(policy)}
        staging = ResumableStaging(spark, options.out, options.resume, job)
    staging = staging or Staging(spark, options.out)
    # Storage changes while it is read: all parts of the plan see one listing.
    listing = staging.keep(file_inventory(spark, options.root), "inventory")
    plan = plan_cleanup(spark, tables, listing, policy, options.as_of, staging=staging)
    plan = plan.write(options.out)
    if options.apply:
        apply_cleanup(spark, plan, options.out, options.root, dry_run=False)
    return cleanup_report(spark, plan).orderBy("seq")


def _scan(spark: SparkSession, options, tables: dict[str, DataFrame], policy: RetentionPolicy) -> DataFrame:
    registry = tables.get("ghost_registry")
    if registry is None:
        registry = spark.createDataFrame([], SCHEMAS["ghost_registry"])
    staging = Staging(spark, options.out)
    updated, found = run_scan(spark, options.root, tables["files"], registry, staging)
    updated.drop("change").write.parquet(f"{options.out}/ghost_registry")
    return found


_JOBS = {"usage": _usage, "requeue": _requeue, "cleanup": _cleanup, "scan": _scan}


def main(argv: Sequence[str], spark: SparkSession | None = None) -> DataFrame:
    """Run a job and return what it shows."""
    options = _arguments().parse_args(argv)
    if getattr(options, "resume", None) and options.as_of is None:
        raise SystemExit("--resume needs --as-of: a plan that goes on must not have another time")
    options.as_of = options.as_of if options.as_of is not None else int(time.time())
    spark = configure(spark or SparkSession.builder.appName("cleanlake").getOrCreate())
    if not path_exists(spark, options.tables):
        raise SystemExit(f"there is nothing at {options.tables}")
    tables = read_tables(spark, SCHEMAS, location=options.tables)
    policy = stored_policy(tables["config"]) if "config" in tables else RetentionPolicy()
    return _JOBS[options.job](spark, options, tables, policy)


if __name__ == "__main__":
    main(sys.argv[1:]).show(1000, truncate=False)
