"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. The line keys of a batch are merge-anti-joined with the run of keys
already known to be frequent; what is left is added as a new sorted run of (key, documents).
Whenever a level holds ``fan_in`` runs they are compacted to one run of the next level, and keys
that reach the threshold move to the run of frequent keys. So a key is written once per level and
the work of a batch does not grow with the number of batches before it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm.shared import BLANK_CHARS, fresh_folder, lower_ascii, table, written

_KEY = ["k1", "k2"]


class LineRuns:
    """Sorted runs of (key, documents) in the shared folder, level by level.

    A run is hash-distributed and sorted by key. ``frequent`` holds the keys found in
    at least ``min_docs`` documents, once :meth:`finish` has been called.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 4):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.folder = fresh_folder(spark, "line-runs")
        self.levels: list[list[DataFrame]] = [[]]
        self.found: list[DataFrame] = []
        self._runs = 0

    def _run(self, keys: DataFrame) -> DataFrame:
        self._runs += 1
        path = f"{self.folder}/run-{self._runs:05d}"
        keys.repartition(*_KEY).sortWithinPartitions(*_KEY).write.parquet(path)
        return self.spark.read.schema(keys.schema).parquet(path)

    def add(self, batch: DataFrame) -> None:
        """``batch``: (k1, k2, n), a row for each key; its documents are in no other batch."""
        for run in self.found:
            batch = batch.join(run.hint("merge"), _KEY, "left_anti")
        self.levels[0].append(self._run(batch))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """Merge the runs of a level. What is frequent now is not looked at again."""
        merged = reduce(DataFrame.unionByName, self.levels[level])
        merged = self._run(merged.groupBy(*_KEY).agg(F.sum("n").alias("n")))
        self.found.append(self._run(merged.where(F.col("n") >= self.min_docs).select(*_KEY)))
        rest = merged.where(F.col("n") < self.min_docs)
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(rest)
        if len(self.found) > self.fan_in:
            self.found = [self._run(reduce(DataFrame.unionByName, self.found))]

    def finish(self) -> DataFrame:
        """All frequent keys. Runs of several levels are merged for the last time."""
        runs = [run for level in self.levels for run in level]
        if runs:
            total = reduce(DataFrame.unionByName, runs).groupBy(*_KEY).agg(F.sum("n").alias("n"))
            found = total.where(F.col("n") >= self.min_docs).select(*_KEY)
            for run in self.found:
                found = found.join(run.hint("merge"), _KEY, "left_anti")
            self.found.append(self._run(found))
            self.levels = [[]]
        return reduce(DataFrame.unionByName, self.found)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    batches: int = 16,
) -> DataFrame:
    """``docs`` with the lines dropped whose key occurs in at least ``min_docs`` documents.

    All columns stay; the text column has the lines that are kept, joined by a line feed, and
    ``n_lines`` and ``n_dropped`` are added (columns of these names in ``docs`` are replaced).

    A null or empty text is one empty line; a null stays null. A line's key is the line without
    blanks at both ends and with A to Z in lower case; empty keys are never dropped. Rows with
    the same id are one document when documents are counted, and each row is kept. Rows with a
    null id are one document. An empty table gives an empty table.

    Documents are dealt into ``batches`` by their id. Each batch reads the line hashes once more, so their
    number is fixed; with four times the fan-in most batches meet a run of frequent keys, and
    runs are merged on two levels.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop(*({"n_lines", "n_dropped"} & set(docs.columns)))
    known = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("code"), text.alias("t"))
    lines = known.select("id", "code", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    key = F.trim("line", F.lit(BLANK_CHARS))
    lines = lines.select("id", "code", "at", lower_ascii(key).alias("key")).where("key <> ''")
    # 128 bits tell the keys apart: two hashes from different seeds.
    lines = lines.select(
        "id", "code", "at",
        F.xxhash64("key").alias("k1"),
        F.xxhash64(F.lit(7), "key").alias("k2"),
    )
    lines = written(lines, "lines")

    runs = LineRuns(spark, min_docs)
    for i in range(batches):
        batch = lines.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i)
        batch = batch.select("id", *_KEY).distinct()
        runs.add(batch.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")))
    frequent = runs.finish()

    doomed = lines.join(frequent, _KEY, "left_semi")
    doomed = doomed.groupBy("id", "code").agg(F.collect_set("at").alias("doomed"))
    # A row travels as one value, so names of its columns clash with none here.
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_code"),
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_code") == F.col("code"))
    rows = rows.join(doomed, same, "left")
    own = F.col("row")[text_col]
    rows = rows.withColumn("lines", F.split(F.coalesce(own, F.lit("")), "\n"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    rows = rows.withColumn("kept", F.array_except(every, F.coalesce("doomed", F.array().cast("array<int>"))))
    lines_of = F.col("lines")
    kept = F.array_join(F.transform("kept", lambda at: lines_of[at]), "\n")
    return rows.select(
        *[
            (F.when(own.isNotNull(), kept) if c == text_col else F.col("row")[c]).alias(c)
            for c in docs.columns
        ],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("doomed"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10)
    return out.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), keyed as (
    select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), frequent as (
    select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
), judged as (
    select k.*, f.key is not null as doomed from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (doomed) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not doomed), ''))
           as kept_sha256
from judged group by doc_id
"""
