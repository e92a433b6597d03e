"""Sets of whole-number keys as bitmaps over blocks of 32,768 keys.

Ids lie close together, so even the ids of a large parent are a few MB of bitmaps. Those go to the rows,
and rows that are looked up in the set are not shuffled. A set that would not be smaller as
bitmaps, or too large to be sent, or whose keys are no whole numbers, stays a table and is joined as
one. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bytes of the bitmap of one block; the engine's bitmap functions fix it.
BLOCK_BYTES = 4096
#: Bytes of bitmaps that are still sent to all executors: 268 million ids without gaps.
MOST_BYTES = 32 * 1024 * 1024
#: Least bytes that a key takes in a table that is sent to all executors.
KEY_BYTES = 16


def _bytes(bits: Column) -> Column:
    """A bitmap as an array of its bytes less 128, so that each is read as a number once and not for every row."""
    at = F.sequence(F.lit(1), F.lit(BLOCK_BYTES))
    return F.transform(
        at, lambda i: (F.conv(F.hex(F.substring(bits, i, F.lit(1))), 16, 10).cast("int") - 128).cast("tinyint")
    )


def _is_set(bits: Column, key: Column) -> Column:
    at = F.bitmap_bit_position(key).cast("int")
    byte = F.get(bits, F.shiftright(at, 3)).cast("int") + 128
    return F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1) == 1


@dataclass(frozen=True)
class KeySet:
    """Bitmaps (``_block``, ``_bits``) of keys. A null key is in no set."""

    blocks: DataFrame

    def _join(self, rows: DataFrame, column: str, how: str) -> DataFrame:
        key = rows[column].cast("bigint")
        found = (F.bitmap_bucket_number(key) == F.col("_block")) & _is_set(F.col("_bits"), key)
        return rows.join(F.broadcast(self.blocks), found, how)

    def having(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose key is in the set."""
        return self._join(rows, column, "left_semi")

    def lacking(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose key is null or not in the set."""
        return self._join(rows, column, "left_anti")

    def marking(self, rows: DataFrame, column: str, mark: str) -> DataFrame:
        """All rows, and whether their key is in the set."""
        columns = [F.col(c) for c in rows.columns]
        return self._join(rows, column, "left").select(*columns, F.col("_block").isNotNull().alias(mark))


def is_whole(rows: DataFrame, column: str) -> bool:
    return isinstance(rows.schema[column].dataType, IntegralType)


def key_set(
    rows: DataFrame,
    column: str = "id",
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
    label: str = "",
) -> KeySet | None:
    """The values of a column as bitmaps, or None where they are to be joined as a table.

    It counts the blocks in a job of its own, so ``rows`` is a table or was written. ``keep`` may write
    the bitmaps where several joins look at them. Rows with one key go to one task: pass distinct
    keys where one may have very many rows.
    """
    # Who turns broadcasts off has them off here too.
    limit = rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not is_whole(rows, column) or limit.startswith("-"):
        return None
    keys = rows.select(F.col(column).cast("bigint").alias("_key")).where(F.col("_key").isNotNull())
    block = F.bitmap_bucket_number("_key").alias("_block")
    n_keys, n_blocks = keys.agg(F.count("_key"), F.approx_count_distinct(block, 0.02)).first()
    if n_blocks * BLOCK_BYTES > min(MOST_BYTES, n_keys * KEY_BYTES):
        return None
    blocks = (
        # Bitmaps of parts of a block are not shuffled: as many as tasks times blocks, they would
        # grow faster than the keys.
        keys.select("_key", block)
        .repartition("_block")
        .groupBy("_block")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_key")).alias("_bits"))
        .select("_block", _bytes(F.col("_bits")).alias("_bits"))
    )
    return KeySet(blocks if keep is None else keep(blocks, label))
