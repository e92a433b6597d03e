"""State of a planned clean-up, and the step and rule interfaces."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from threading import Event
from typing import Protocol

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.operators.key_sets import KeySet, key_set
from cleanlake.operators.modules import CascadeRule
from cleanlake.operators.orphans import first_rule, survivors
from cleanlake.plans.staging import Staging
from cleanlake.policy import RetentionPolicy


@dataclass
class Run:
    """Tables as they stand while a clean-up is planned.

    Steps add doomed rows; ``live`` shows a table without those doomed so far, which is
    what later rules must look at. The given tables are never changed.
    """

    tables: Mapping[str, DataFrame]
    inventory: DataFrame
    policy: RetentionPolicy
    as_of: int
    staging: Staging
    recheck_ghosts: bool = True
    safe_shared_content: bool = False
    undeletable: Iterable[str] = ()
    cascade_rules: Sequence[CascadeRule] | None = None
    doomed: dict[str, DataFrame] = field(default_factory=dict)
    unlinks: list[DataFrame] = field(default_factory=list)
    catalog: list[tuple[str, str, str, str]] = field(default_factory=list)
    checked_out: DataFrame | None = None
    tombstones: DataFrame | None = None
    gone_modules: DataFrame | None = None

    def has(self, table: str) -> bool:
        return table in self.tables

    def keys(self, rows: DataFrame, label: str = "") -> DataFrame | KeySet:
        """The ids of written rows as a set, written too under a label, or the rows where that does not pay."""
        return key_set(rows, keep=self.staging.keep if label else None, label=f"set-{label}") or rows

    def live(self, table: str) -> DataFrame:
        rows = self.tables[table]
        return survivors(rows, self.keys(self.doomed[table])) if table in self.doomed else rows

    def live_written(self, table: str, *columns: str) -> DataFrame:
        """Columns of ``live``, written once for the rules that look at them. Where nothing is
        doomed that is the table itself."""
        rows = self.live(table).select(*columns)
        return self.staging.keep(rows, f"live-{table}") if table in self.doomed else rows

    def doom(
        self,
        step: str,
        table: str,
        rules: Sequence[tuple[str, DataFrame]],
        stage: bool = False,
        size: str | None = None,
    ) -> None:
        """Add rows of ``table``, each under the first of the ordered rules that names it.

        ``size`` is the column that holds the bytes a row stands for.
        """
        sized = F.lit(0).cast("bigint") if size is None else F.col(size).cast("bigint")
        named = [(name, rows.select("id", sized.alias("bytes"))) for name, rows in rules]
        found = first_rule(named)
        self.add(step, table, [name for name, _ in rules], found, stage)

    def add(
        self, step: str, table: str, rules: Sequence[str], found: DataFrame, stage: bool = False
    ) -> None:
        """Add rows ``(id, rule, bytes)`` of ``table`` that no earlier step has doomed."""
        columns = ("id", "step", "rule", "bytes")
        found = found.select("id", F.lit(step).alias("step"), "rule", "bytes")
        earlier = self.doomed.get(table)
        if earlier is not None:
            found = survivors(found, self.keys(earlier)).select(*columns)
        if stage:
            found = self.staging.keep(found, f"{step}-{table}")
        self.doomed[table] = found if earlier is None else earlier.unionByName(found)
        self.catalog += [(step, table, name, "ok") for name in rules]

    def skip(self, step: str, table: str, rule: str) -> None:
        self.catalog.append((step, table, rule, "skipped"))

    def unlinked_paths(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.unlinks) if self.unlinks else None


class CleanupStep(Protocol):
    """One step of a clean-up: looks at the run and dooms rows in it.

    A step may have ``after``: the names of the steps whose doomed rows it must see. It then dooms rows of
    no table that another step beside it looks at.
    """

    name: str

    def plan(self, run: Run) -> None: ...


def in_order(steps: Sequence[CleanupStep], run: Run) -> None:
    """Plan the steps, side by side where ``after`` allows. Jobs of a step come from its own thread."""
    spark = run.staging.spark
    through = [Event() for _ in steps]
    failed: list[BaseException] = []

    def waits_for(number: int) -> list[int]:
        after = getattr(steps[number], "after", None)
        return [k for k in range(number) if after is None or steps[k].name in after]

    def work(number: int) -> None:
        try:
            for k in waits_for(number):
                through[k].wait()
            if not failed:
                steps[number].plan(run)
        except BaseException as problem:
            failed.append(problem)
        finally:
            through[number].set()

    threads = [InheritableThread(target=work, args=(k,), session=spark) for k in range(len(steps))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failed:
        raise failed[0]
    order = {step.name: k for k, step in reversed(list(enumerate(steps)))}
    run.catalog.sort(key=lambda entry: order.get(entry[0], len(order)))


@dataclass(frozen=True)
class Rule:
    """The simplest step: doom the rows of one table that ``select`` returns."""

    name: str
    table: str
    select: Callable[[Run], DataFrame]
    size: str | None = None

    def plan(self, run: Run) -> None:
        if run.has(self.table):
            run.doom(
                self.name, self.table, [(self.name, self.select(run))], stage=True, size=self.size
            )
        else:
            run.skip(self.name, self.table, self.name)
