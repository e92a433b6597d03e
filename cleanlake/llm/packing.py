"""Packing documents into training sequences: best fit, then swap-based local search.

Documents become pieces of at most one sequence. Pieces are dealt by hash into groups of bounded
size, each packed by itself: best fit in descending length, then exchanges between underfull
sequences. An exchange moves a piece, or swaps one for one or two for one, so that the fuller
sequence gains what the emptier loses; the sum of squared fills grows with each, and emptier
sequences run out of pieces. Only lengths travel; texts are read once, where they lie.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm.shared import forget, per_worker, slices, table, written
from cleanlake.llm.tokens import ChunkEncoder

#: Pieces that one task packs together; a group of this size wastes about one sequence.
GROUP = 20_000
#: Entries of the encoder's memos; as many take some 100 MB.
MEMO = 200_000
#: Exchanges that a pass looks for, for each underfull sequence.
TRIES = 60


class _Sequences:
    """Sequences as sorted lists of (length, piece)."""

    def __init__(self, size: int):
        self.size = size
        self.items: list[list[tuple[int, int]]] = []
        self.free: list[int] = []

    def best_fit(self, pieces: list[tuple[int, int]]) -> None:
        """Descending best fit. ``open_``: sequences by free room; ``mask``: which rooms occur."""
        open_: list[list[int]] = [[] for _ in range(self.size + 1)]
        mask = 0
        for length, piece in sorted(pieces, reverse=True):
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                at = open_[room].pop()
                if not open_[room]:
                    mask &= ~(1 << room)
            else:
                room, at = self.size, len(self.items)
                self.items.append([])
                self.free.append(self.size)
            self.items[at].append((length, piece))
            self.free[at] = room - length
            if room > length:
                open_[room - length].append(at)
                mask |= 1 << (room - length)
        for items in self.items:
            items.sort()

    def _move(self, a: int, b: int, out: list[tuple[int, int]], back: list[tuple[int, int]]) -> None:
        for x in out:
            self.items[a].remove(x)
            insort(self.items[b], x)
        for x in back:
            self.items[b].remove(x)
            insort(self.items[a], x)
        gain = sum(x[0] for x in out) - sum(x[0] for x in back)
        self.free[a] += gain
        self.free[b] -= gain

    def _exchange(self, a: int, b: int) -> bool:
        """The exchange that adds most to the fuller sequence ``b`` without overfilling it."""
        room, from_a, from_b = self.free[b], self.items[a], self.items[b]
        best, out, back = 0, [], []
        i = bisect_right(from_a, (room, 1 << 62)) - 1
        if i >= 0:
            best, out = from_a[i][0], [from_a[i]]
        for y in from_b:
            if best == room:
                break
            i = bisect_right(from_a, (y[0] + room, 1 << 62)) - 1
            if i >= 0 and from_a[i][0] - y[0] > best:
                best, out, back = from_a[i][0] - y[0], [from_a[i]], [y]
            # Two for one: the two-pointer walk finds the largest sum that still fits.
            low, high = 0, len(from_a) - 1
            while low < high and best < room:
                gain = from_a[low][0] + from_a[high][0] - y[0]
                if gain > room:
                    high -= 1
                else:
                    if gain > best:
                        best, out, back = gain, [from_a[low], from_a[high]], [y]
                    low += 1
        if best:
            self._move(a, b, out, back)
        return best > 0

    def improve(self, passes: int) -> None:
        """Take from the emptiest sequences for fuller ones, until as few as possible are left.

        A pass walks the underfull sequences from the emptiest on; each gives to the fuller ones in
        turn, fullest first. It ends early at the least number that the lengths allow, and
        when no exchange is left.
        """
        least = -(-sum(self.size - f for f in self.free) // self.size)
        for _ in range(passes):
            live = [i for i, x in enumerate(self.items) if x and self.free[i]]
            full = sum(1 for i, x in enumerate(self.items) if x and not self.free[i])
            if full + len(live) <= least:
                return
            live.sort(key=lambda i: -self.free[i])
            changed, tries = False, TRIES * len(live)
            for at, a in enumerate(live):
                for b in reversed(live[at + 1 :]):
                    if not self.items[a] or tries <= 0:
                        break
                    while self.free[b] and self.items[a] and self.free[a] >= self.free[b]:
                        tries -= 1
                        if not self._exchange(a, b):
                            break
                        changed = True
            if not changed:
                return


def pack_lengths(lengths: list[int], size: int, passes: int = 20) -> list[tuple[int, int]]:
    """(sequence, offset) of each of the lengths, all between 1 and ``size``."""
    packed = _Sequences(size)
    packed.best_fit([(n, i) for i, n in enumerate(lengths)])
    packed.improve(passes)
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    number = 0
    for items in packed.items:
        offset = 0
        for length, piece in items:
            place[piece] = (number, offset)
            offset += length
        number += bool(items)
    return place


def _pieces(path: str, keeps_space: bool, end_id: int, size: int):
    end = end_id.to_bytes(4, "little")
    columns = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        args = (path, "<u4", keeps_space, MEMO)
        encoder = per_worker(args, lambda: ChunkEncoder(*args))
        for batch in batches:
            ids, codes, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for i, j in slices(texts, 1_000_000):
                take, rows = [], []
                for at, data in enumerate(encoder.encode(texts[i:j]), i):
                    data += end
                    n = len(data) // 4
                    cut = n % size or size
                    start = 0
                    for piece in range(-(-n // size)):
                        stop = cut + piece * size
                        crc = zlib.crc32(data[4 * start : 4 * stop])
                        take.append(at)
                        rows.append((piece, start, stop - start, crc))
                        start = stop
                take = pa.array(take, pa.int64())
                piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take), codes.take(take), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=columns,
                )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    size: int = 1024,
    keeps_space: bool = True,
    group: int = GROUP,
) -> DataFrame:
    """The pieces of every document and where each goes.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id``
    alone. Only documents longer than ``size`` are cut, into pieces of ``size``, of which the first
    may be shorter. Returns id, ``piece``, ``start`` (the document's ids before it), ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``. Pieces of full length are a sequence each.
    Repeated rows are documents of their own; an empty table gives an empty table.

    ``tokenizer`` is a file that every executor has at that path.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col)
    )
    pieces = source.mapInArrow(
        _pieces(tokenizer, keeps_space, end_id, size),
        f"doc_id {id_type}, row long, piece int, start long, length long, ids_crc32 long",
    )
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < size).count() // group))

    schema = "doc_id {0}, piece int, start long, length long, ids_crc32 long, {1}"
    schema = schema.format(id_type, "sequence_id long, offset long")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        forget()
        g = int(rows["_group"].iloc[0])
        rows = rows.sort_values(["doc_id", "piece", "row"]).reset_index(drop=True)
        at = pack_lengths(rows["length"].tolist(), size)
        rows["sequence_id"] = [s * groups + g for s, _ in at]
        rows["offset"] = [o for _, o in at]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    short = pieces.where(F.col("length") < size)
    spread = F.pmod(F.xxhash64("doc_id", "row", F.monotonically_increasing_id()), F.lit(groups))
    short = short.withColumn("_group", spread)
    short = short.groupBy("_group").applyInPandas(place, schema)
    # Numbers below zero are for full pieces: any that differ will do.
    full = pieces.where(F.col("length") == size).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return short.unionByName(full).withColumnRenamed("doc_id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
