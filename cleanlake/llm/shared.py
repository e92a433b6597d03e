"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.plans.staging import checkpoint_folder

#: The white space of the word and line rules, as members of a regular expression's class.
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Row groups of about 8 MB. Parquet's writers would else look at the size of a page or of a row group after a
#: hundred rows first, and its readers take a row group of so few rows as one batch.
LARGE_ROWS = {
    "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1,
}


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """``frame`` as a table in the shared folder: read twice, it is made once, and the
    lineage ends there, so a lost executor costs no earlier step. ``large_rows``: rows have megabytes
    each, and few of them lie in memory at once, both here and where they are read."""
    spark = frame.sparkSession
    path = fresh_folder(spark, label)
    options = LARGE_ROWS if large_rows else {}
    frame.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is. ``lower`` does just that to pure ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters; a longer text makes a range alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, kept for the next tasks of this Python worker until another key is
    asked for. The code of a task is sent anew each time; this outlives it."""
    kept = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")).__dict__
    if kept.get("key") != key:
        kept.pop("value", None)
        kept["value"], kept["key"] = make(), key
    return kept["value"]


def forget() -> None:
    """Drop what ``per_worker`` keeps and give free memory back to the system. Tasks that need memory
    for other things begin with it: workers outlive stages, and what one of them has once taken
    would stay taken."""
    per_worker("nothing", lambda: None)
    gc.collect()
    trimmed()


def trimmed() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bits of a filter of keys, 16 MB in all, and of one row of it; the engine's bitmap functions fix the latter.
FILTER_BITS, ROW_BITS = 1 << 27, 32_768


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bit for each key (a 64-bit hash): at most 4,096 rows of 4 KB, however many keys there are."""
    place = F.pmod(column, F.lit(FILTER_BITS))
    rows = keys.select(place.alias("_at")).selectExpr(f"_at div {ROW_BITS} as _row", f"_at % {ROW_BITS} as _bit")
    # Dealt by row first, so that tasks do not each send a filter of their own.
    rows = rows.repartition("_row").groupBy("_row")
    return written(rows.agg(F.bitmap_construct_agg("_bit").alias("_bits")), "key-filter")


def passing(rows: DataFrame, code: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``code`` is among the keys of the filter, and few others: as many as one in
    the number of bits for each key. Beyond tens of millions of keys it lets more and more through,
    so what follows must not rely on it. The filter goes to all executors; its size is fixed."""
    placed = rows.withColumn("_at", F.pmod(code, F.lit(FILTER_BITS)))
    placed = placed.withColumn("_row", F.expr(f"_at div {ROW_BITS}"))
    found = placed.join(F.broadcast(keys), "_row")
    byte = f"cast(conv(hex(substring(_bits, cast((_at % {ROW_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
    return found.where(f"shiftright({byte}, cast(_at % 8 as int)) & 1 = 1").select(*rows.columns)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """From here on the session sends at most so many rows at once to Python workers. A batch lies in memory
    several times on its way, outside the heap of the executor too, and what that has once taken stays
    taken. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def hash_code(*columns: str) -> Column:
    """A hash of 60 bits, not below 0."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def lowest(rows: DataFrame, by: str, code: Column, most: int) -> DataFrame:
    """Of each value of ``by`` the rows with the lowest codes: ``most`` of them, at most twice as many
    (or all that have one code), or all there are. The hash of a null is the same low code for all
    nulls: callers leave nulls out or hash more columns, and give distinct codes for a strict bound.

    Found by counting codes by their leading bits, then by the next ones where one count is still too
    large: nothing is sorted, and only 4,096 counts of each value come to the driver.
    """
    rows = rows.withColumn("_code", code)
    taken: dict[Any, int] = {}
    prefix: dict[Any, int] = {}
    limit: dict[Any, int] = {}
    spark = rows.sparkSession
    for shift in range(48, -12, -12):
        part = rows.select(by, "_code")
        if prefix:
            open_ = [(k, p) for k, p in prefix.items() if k not in limit]
            if not open_:
                break
            wanted = spark.createDataFrame(open_, f"{by} {rows.schema[by].dataType.simpleString()}, _p long")
            part = part.join(F.broadcast(wanted), by)
            part = part.where(F.shiftright("_code", shift + 12) == F.col("_p"))
        bits = F.shiftright("_code", shift).bitwiseAND(4095).alias("bits")
        counts: dict[Any, list[tuple[int, int]]] = {}
        for r in part.where(F.col(by).isNotNull()).groupBy(by, bits).count().collect():
            counts.setdefault(r[0], []).append((r["bits"], r["count"]))
        for key, found in counts.items():
            total = taken.get(key, 0)
            for value, n in sorted(found):
                if total + n >= most:
                    prefix[key] = (prefix.get(key, 0) << 12) | value
                    if total + n <= 2 * most or shift == 0:
                        limit[key] = ((prefix[key] + 1) << shift) - 1
                    taken[key] = total
                    break
                total += n
            else:
                limit[key] = (1 << 60) - 1
                prefix.setdefault(key, 0)
    schema = f"{by} {rows.schema[by].dataType.simpleString()}, _limit long"
    limits = spark.createDataFrame(list(limit.items()), schema)
    return rows.join(F.broadcast(limits), by).where("_code <= _limit").drop("_limit")


def numbered(rows: DataFrame, by: str, order: list[Column], kept: list[Column]) -> DataFrame:
    """``by``, ``i`` and ``kept``: rows are numbered from 0 within each value of ``by``, in that order.
    Values of ``by`` must not be null.

    Rows are dealt by ranges of (``by``, ``order``), so no value comes to one task; each task counts its
    own, and what earlier tasks have of its first value is added from one row per task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order)
    dealt = dealt.select(F.col(by), *kept)

    def count(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(first[1:], len(keys))
            at = np.arange(len(keys), dtype=np.int64) - np.repeat(first, ends - first)
            if last is not None and len(keys) and keys[0] == last:
                at[: ends[0]] += n
            if len(keys):
                last, n = keys[-1], int(at[-1]) + 1
            own = [pa.array(np.full(len(keys), part, np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "_part", "i"])

    schema = dealt.schema.simpleString()[len("struct<"):-1]
    out = written(dealt.mapInArrow(count, schema + ",_part:int,i:bigint"), "numbered")
    tasks = out.groupBy("_part").agg(F.min(by).alias("first"), F.max(F.struct(by, "i")).alias("last"))
    before, held, had = [], None, 0
    for r in sorted(tasks.collect()):
        more = had if r["first"] == held else 0
        before.append((r["_part"], r["first"], more))
        held, had = r["last"][0], r["last"]["i"] + 1 + (more if r["last"][0] == r["first"] else 0)
    kind = dealt.schema[by].dataType.simpleString()
    before = spark.createDataFrame(before, f"_part int, _first {kind}, _before long")
    out = out.join(F.broadcast(before), "_part")
    more = F.when(F.col(by) == F.col("_first"), F.col("_before")).otherwise(0)
    return out.withColumn("i", F.col("i") + more).drop("_part", "_first", "_before")
