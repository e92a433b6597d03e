"""Cascades along foreign keys to a fixpoint.

Tables and foreign keys form a graph, which may have cycles and keys from a table to itself. Rows
that are doomed doom the rows that refer to them, and so on until nothing new is found. Each round
follows the keys of the last round's new rows only, and what it finds is a written table, so neither
plans nor joins grow with the number of rounds. Rows found go to those known so far, which stay where they
lie: no round sends what earlier ones found.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.plans.staging import Staging

#: The rule of the rows that a cascade begins with.
SEED = "seed"
_RESULT = "id {0}, depth int, rule string"


@dataclass(frozen=True)
class ForeignKey:
    """Rows of ``child`` go with the row of ``parent`` that they refer to.

    ``keys`` maps columns of the child to columns of the parent, ``where`` columns of the child to
    constants. A null in a key refers to nothing.
    """

    child: str
    parent: str
    keys: Mapping[str, str]
    where: Mapping[str, object] = field(default_factory=dict)
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or f"{self.child}_of_{self.parent}"


def _needed(table: str, rules: Sequence[ForeignKey]) -> list[str]:
    """The id and the columns by which other rows refer to rows of a table."""
    columns = {c for rule in rules if rule.parent == table for c in rule.keys.values()}
    return ["id", *sorted(columns - {"id"})]


def referring(child: DataFrame, parents: DataFrame, rule: ForeignKey, staging: Staging, label: str) -> DataFrame:
    """Rows of ``child`` that refer to one of ``parents``.

    The keys are reduced and written first: their size is known then, and a key that very many
    children have is split between two plain shuffles.
    """
    for column, value in rule.where.items():
        child = child.where(F.col(column) == F.lit(value))
    keys = parents.select(*[F.col(p).alias(c) for c, p in rule.keys.items()]).dropna().distinct()
    return child.join(staging.keep(keys, label), list(rule.keys), "left_semi")


class _Doomed:
    """What is doomed in one table so far: a folder with a part for each round."""

    def __init__(self, staging: Staging, table: str, columns: Sequence[str], schema: str):
        self._staging, self._table, self._columns = staging, table, columns
        self._schema, self._depths = schema, []

    def _path(self, depth: int) -> str:
        return f"{self._staging.folder}/doomed-{self._table}/depth={depth}"

    def add(self, rows: DataFrame, depth: int) -> DataFrame:
        label = self._path(depth).removeprefix(f"{self._staging.folder}/")
        kept = self._staging.keep(rows.select(*self._columns, "rule"), label)
        if not kept.isEmpty():
            self._depths.append(depth)
        return kept

    def read(self) -> DataFrame:
        """(columns, rule, depth) of all rounds, by one scan however many there are."""
        spark = self._staging.spark
        if not self._depths:
            return spark.createDataFrame([], f"{self._schema}, rule string, depth int")
        reader = spark.read.schema(f"{self._schema}, rule string, depth int")
        folder = self._path(0).rpartition("/")[0]
        return reader.option("basePath", folder).parquet(*[self._path(d) for d in self._depths])

    def lacking(self, rows: DataFrame, depth: int) -> DataFrame:
        """Those of ``rows`` that no earlier round has found. They are written first, so their size is known."""
        if not self._depths:
            return rows
        rows = self._staging.keep(rows, f"found-{self._table}/depth={depth}")
        again = self.read().select("id").join(rows.select("id"), "id", "left_semi")
        return rows.join(again, "id", "left_anti")


def cascade_to_fixpoint(
    tables: Mapping[str, DataFrame],
    rules: Sequence[ForeignKey],
    seeds: Mapping[str, DataFrame],
    staging: Staging,
) -> dict[str, DataFrame]:
    """(``id``, ``depth``, ``rule``) of all rows that go, per table that loses any.

    ``seeds`` has the ids that a cascade begins with, per table, at depth 0; ids that a table does not
    have are passed over. ``depth`` is the least number of keys to follow from a seed, and ``rule`` the
    first in the order of ``rules`` that leads there in so many. Ids are primary keys; a row without one
    is not named and leads nowhere. Rules of tables that are not there are passed over. It ends after
    as many rounds as the longest way from a seed, whatever cycles there are.
    """
    rules = [r for r in rules if r.child in tables and r.parent in tables]
    names = {*(t for t in seeds if t in tables), *(r.child for r in rules)}
    doomed, columns = {}, {}
    for table in sorted(names):
        columns[table] = _needed(table, rules)
        kinds = tables[table].select(*columns[table]).schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
        doomed[table] = _Doomed(staging, table, columns[table], schema)

    new = {}
    for table in sorted(t for t in seeds if t in tables):
        ids = staging.keep(seeds[table].select("id").distinct(), f"seeds-{table}")
        rows = tables[table].select(*columns[table]).join(ids, "id", "left_semi")
        rows = doomed[table].add(rows.withColumn("rule", F.lit(SEED)), 0)
        if not rows.isEmpty():
            new[table] = rows
    depth = 0
    while new:
        depth += 1
        found = {}
        for table in sorted({r.child for r in rules if r.parent in new}):
            ranked = []
            for rank, rule in enumerate(rules):
                if rule.child == table and rule.parent in new:
                    label = f"keys-{depth}-{rank}"
                    rows = referring(tables[table], new[rule.parent], rule, staging, label)
                    ranked.append(rows.select(*columns[table], F.lit(rank).alias("rank")))
            rows = reduce(DataFrame.unionByName, ranked).where(F.col("id").isNotNull())
            if len(ranked) > 1:
                rows = rows.groupBy(*columns[table]).agg(F.min("rank").alias("rank"))
            rows = doomed[table].lacking(rows, depth)
            labels = F.array(*[F.lit(r.label) for r in rules])
            rows = doomed[table].add(rows.withColumn("rule", F.element_at(labels, F.col("rank") + 1)), depth)
            if not rows.isEmpty():
                found[table] = rows
        new = found
    out = {t: d.read().select("id", "depth", "rule") for t, d in doomed.items() if d._depths}
    return out
