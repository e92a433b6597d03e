"""Token ids in a compressed binary format: canonical, length-limited Huffman codes.

The code is built from the counts of all ids (package-merge, at most ``max_bits`` bits) and kept as
a list of (id, length). Documents in ascending id order are cut into blocks that are decoded by
themselves. A block holds its documents' ids and token counts, the bit stream, and a checkpoint, the
bit offset of every ``EVERY``-th token. Decoding starts at all checkpoints at once and takes one
table look-up for a token.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanlake.llm.shared import fresh_folder, per_worker, slices, table, written
from cleanlake.llm.tokens import ChunkEncoder

MAGIC = b"TIDH"
EVERY = 256
BLOCK_TOKENS = 1 << 19
_HEAD = "<4sBIQI"


def code_lengths(counts: dict[int, int], max_bits: int = 16) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` bits, by package-merge.

    A list holds what one bit position can buy: single ids, and pairs of what the position below
    bought. The cheapest 2n - 2 entries of the last list tell how long each code is. Equal
    weights are taken in the order of ids, so the code depends on the counts alone.
    """
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n <= 1:
        return {i: 1 for i in ids}
    max_bits = max(max_bits, (n - 1).bit_length())
    weights = np.array([counts[i] for i in ids], np.int64)
    # A list is kept as its weights and, for each entry, whether it is a single id.
    levels, below = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate([weights, below])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        levels.append(order < n)
        pairs = len(merged) // 2
        below = merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    # The first k entries of a list hold its s cheapest ids and k - s packages, which are the first
    # 2 (k - s) entries of the list below.
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for single in reversed(levels):
        s = int(single[:take].sum())
        length[:s] += 1
        take = 2 * (take - s)
    return {i: int(b) for i, b in zip(ids, length)}


def canonical(lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """(id, length, code) in the order of codes: shorter ones first, then by id."""
    out, code, before = [], 0, 0
    for i, bits in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= bits - before
        out.append((i, bits, code))
        code, before = code + 1, bits
    return out


class Encoder:
    def __init__(self, lengths: dict[int, int]):
        most = max(lengths, default=0) + 1
        self.bits, self.code = np.zeros(most, np.int64), np.zeros(most, np.uint64)
        for i, bits, code in canonical(lengths):
            self.bits[i], self.code[i] = bits, code

    def stream(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, most significant bit first, and its checkpoints."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        # A code lies in at most two 32-bit words. Codes do not overlap, so sums are unions, and
        # sums below 2 ** 53 are exact in bincount's floating point.
        wide = self.code[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        word, n = at >> 5, (total >> 5) + 2
        high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        data = (high[:n] + low[:n]).astype(np.uint64).astype(">u4").tobytes()
        return data[: (total + 7) // 8], at[::EVERY].astype("<u8")


class Decoder:
    def __init__(self, lengths: dict[int, int]):
        self.most = most = max(lengths.values(), default=1)
        self.symbol = np.zeros(1 << most, np.uint32)
        self.bits = np.zeros(1 << most, np.int64)
        for i, bits, code in canonical(lengths):
            first, span = code << (most - bits), 1 << (most - bits)
            self.symbol[first : first + span] = i
            self.bits[first : first + span] = bits

    def ids(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All ``n`` ids: a step takes the next token after every checkpoint."""
        if not n:
            return np.empty(0, np.uint32)
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, last = checkpoints.astype(np.int64), len(words) - 1
        out = np.empty((EVERY, len(at)), np.uint32)
        drop, full = np.uint32(32 - self.most), n - EVERY * (len(at) - 1)
        for step in range(EVERY):
            if step == full:  # the last lane is at its end
                at = at[:-1]
                if not len(at):
                    break
            window = words[at >> 3] << (at & 7).astype(np.uint32) >> drop
            out[step, : len(at)] = self.symbol[window]
            at = np.minimum(at + self.bits[window], 8 * last)
        return out.T.reshape(-1)[:n]


def pack_block(ids: list[int | None], counts: np.ndarray, stream: bytes, marks: np.ndarray) -> bytes:
    null = np.array([i is None for i in ids], np.uint8)
    keys = np.array([i or 0 for i in ids], "<i8")
    head = struct.pack(_HEAD, MAGIC, 1, len(ids), int(counts.sum()), len(marks))
    parts = [head, null.tobytes(), keys.tobytes(), counts.astype("<u4").tobytes()]
    return b"".join([*parts, marks.astype("<u8").tobytes(), stream])


def open_block(block: bytes) -> tuple[list[int | None], np.ndarray, bytes, np.ndarray, int]:
    magic, version, n, tokens, marks = struct.unpack_from(_HEAD, block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    at, parts = struct.calcsize(_HEAD), []
    for kind, size in (("u1", n), ("<i8", n), ("<u4", n), ("<u8", marks)):
        parts.append(np.frombuffer(block, kind, size, at))
        at += parts[-1].nbytes
    null, keys, counts, checkpoints = parts
    ids = [None if z else k for z, k in zip(null.tolist(), keys.tolist())]
    return ids, counts.astype(np.int64), block[at:], checkpoints, tokens


def _raw_blocks(path: str, keeps_space: bool, end_id: int, target: int):
    """Tasks hold ascending ranges of documents; their rows become blocks of about ``target``."""
    end = end_id.to_bytes(2, "little")
    names = ["part", "before", "keys", "counts", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        args = (path, "<u2", keeps_space)
        encoder = per_worker(args, lambda: ChunkEncoder(*args))
        keys: list[int | None] = []
        data: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            counts = [len(x) // 2 for x in data]
            columns = [[part], [before], [keys], [counts], [b"".join(data)]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts, 4_000_000):
                for key, ids in zip(own[i:j], encoder.encode(texts[i:j])):
                    keys.append(key)
                    data.append(ids + end)
                    held += len(data[-1]) // 2
                    if held >= target:
                        yield block()
                        before += held
                        keys, data, held = [], [], 0
        if keys:
            yield block()

    return run


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(data, "<u2"), minlength=1 << 16)
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], names=["id", "n"])


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    keeps_space: bool = False,
    max_bits: int = 16,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode every whole text and write ``folder/code`` and ``folder/blocks``.

    The vocabulary must have at most 65,536 ids. A document is its ids and ``end_id``; null and empty
    texts are ``end_id`` alone. Documents are in ascending order of id, nulls first, equal ids in the
    order of a hash of their text; repeated rows are documents of their own. Blocks lie in files of
    Spark's own writer, one row each, so a task that is lost is written again as a whole.
    An empty table gives an empty code and no blocks.
    """
    order = [F.col("key"), F.xxhash64("text")]
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    source = source.repartitionByRange(*order).sortWithinPartitions(*order)
    raw = source.mapInArrow(
        _raw_blocks(tokenizer, keeps_space, end_id, block_tokens),
        "part int, before long, keys array<long>, counts array<int>, ids binary",
    )
    raw = written(raw, "token-ids")

    counted = raw.select("ids").mapInArrow(_counts, "id int, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    # At most a row for each id of the vocabulary.
    lengths = code_lengths({r["id"]: r["n"] for r in counted.collect()}, max_bits)
    spark = docs.sparkSession
    spark.createDataFrame(sorted(lengths.items()), "id int, bits int").coalesce(1).write.parquet(
        f"{folder}/code"
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts, data = (batch.column(c)[k].as_py() for c in (2, 3, 4))
                stream, marks = encoder.stream(np.frombuffer(data, "<u2").astype(np.int64))
                counts = np.array(counts, np.int64)
                block = pack_block(keys, counts, stream, marks)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, 1), batch.column(1).slice(k, 1),
                        pa.array([int(counts.sum())], pa.int64()), pa.array([block], pa.binary()),
                    ],
                    names=["part", "before", "n_tokens", "block"],
                )

    blocks = raw.mapInArrow(encode, "part int, before long, n_tokens long, block binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of :func:`write_ids`: doc_id, ``start`` (ids before it), ``n_tokens``,
    ``ids_crc32`` (of its ids as little-endian 32-bit numbers) and, if asked for, ``ids``."""
    code = spark.read.schema("id int, bits int").parquet(f"{folder}/code").collect()
    lengths = {r["id"]: r["bits"] for r in code}
    blocks = spark.read.schema("part int, before long, n_tokens long, block binary").parquet(
        f"{folder}/blocks"
    )

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            parts, befores = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part, before, block in zip(parts, befores, batch.column(2)):
                keys, counts, data, marks, n = open_block(block.as_py())
                ids = decoder.ids(data, marks, n).astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                own, bounds = ids.tobytes(), list(zip(starts.tolist(), ends.tolist()))
                columns = [
                    pa.array([part] * len(keys), pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.array(starts + before, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(own[4 * a : 4 * b]) for a, b in bounds], pa.int64()),
                ]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in bounds]))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    docs = blocks.select("part", "before", "block").mapInArrow(
        decode, schema + ", ids array<int>" if with_ids else schema
    )
    # A part is a task of the writer: one row each, so the running sum sees few rows.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    docs = docs.join(F.broadcast(base), "part")
    return docs.withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = fresh_folder(spark, "token-files")
    write_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, folder)
