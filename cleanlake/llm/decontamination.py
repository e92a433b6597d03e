"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size. One pass over the documents notes which n-grams of
the block's items each holds. Of an item's n-grams those that few documents hold are its seeds, so
common phrases start no alignment; documents that share a seed are aligned with the item, word by
word, around the places where they share n-grams. Edited copies keep a high local score.

A copy of a short item may keep none of its rare n-grams. Short items are sought by word pairs
instead: the score asked for implies how many of an item's pairs a passage must hold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanlake.llm.shared import forget, slices, table, written

#: Words of a seed; n-grams of an item of which the rarest is always a seed; score of a match, a
#: mismatch and a gap; characters of items in a block.
GRAM, SEGMENT = 3, 6
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 6_000_000
#: Items of fewer words are sought by their word pairs.
SHORT = 40

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """The items of a block as numbered words, sorted n-grams of long ones and word pairs of short ones."""

    def __init__(self, rows: list[tuple[int, str]], n: int = GRAM, least: float = 0.5):
        self.n = n
        split = {key: words_of(text) for key, text in rows}
        self.number = {w: i for i, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
        # n numbers make one 64-bit key. Six million characters hold too few different words to leave no
        # room for three, so this can only be one text longer than a block.
        self.base = len(self.number) + 1
        if self.base**n >= 1 << 63:
            raise ValueError(f"an item of {len(self.number)} different words is too long")
        self.words = {k: self.numbered(ws) for k, ws in split.items() if len(ws) >= n}
        self.long = [k for k, w in self.words.items() if len(w) >= SHORT]
        own = [self.grams(self.words[k]) for k in self.long]
        self.known = np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)
        short = [(k, w) for k, w in self.words.items() if len(w) < SHORT]
        own = [self.grams(w, 2) for _, w in short]
        pairs = np.concatenate([np.empty(0, np.int64), *own])
        order = np.argsort(pairs, kind="stable")
        #: Word pairs, where the list of items of each begins, and these lists.
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.first = np.append(first, len(pairs))
        keys = np.array([k for k, _ in short], np.int64)
        self.holders = np.repeat(keys, [len(g) for g in own])[order]
        self.needed = np.ones(1 + max(self.words, default=0), np.int64)
        for k, w in short:
            self.needed[k] = pairs_needed(len(w), least)

    def numbered(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words], np.int64)

    def grams(self, numbers: np.ndarray, n: int | None = None) -> np.ndarray:
        """A key for each window of n words, -1 if a word of it is in no item."""
        n = n or self.n
        count = max(0, len(numbers) - n + 1)
        out, bad = np.zeros(count, np.int64), np.zeros(count, bool)
        for k in range(n):
            part = numbers[k : k + count]
            out = out * self.base + part
            bad |= part < 0
        out[bad] = -1
        return out

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """Which of the keys are n-grams of an item."""
        if not len(self.known):
            return np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return self.known[at] == grams

    def candidates(self, pairs: np.ndarray) -> np.ndarray:
        """The short items of which a text with these word pairs has as many as a copy needs."""
        own = np.unique(pairs[pairs >= 0])
        if not len(self.pairs) or not len(own):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)
        at = at[self.pairs[at] == own]
        sizes = self.first[at + 1] - self.first[at]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found, counts = np.unique(self.holders[np.repeat(self.first[at], sizes) + within], return_counts=True)
        return found[counts >= self.needed[found]]

    def passages(self, key: int, pairs: np.ndarray) -> np.ndarray:
        """Places of the item's word pairs in a text, where enough are within reach of each other."""
        at = np.flatnonzero(np.isin(pairs, self.grams(self.words[key], 2)) & (pairs >= 0))
        more = int(self.needed[key]) - 1
        if len(at) <= more:
            return at[:0]
        begins = np.flatnonzero(at[more:] - at[: len(at) - more] < 2 * len(self.words[key]))
        covered = np.zeros(len(at) + 1, np.int64)
        np.add.at(covered, begins, 1)
        np.add.at(covered, begins + more + 1, -1)
        return at[np.cumsum(covered)[:-1] > 0]


def pairs_needed(words: int, least: float) -> int:
    """The fewest word pairs of an item that a copy with this score keeps.

    With m words kept in b + 1 runs, the score of 2 m - b at most is to reach 2 * least * words. Words
    replaced or left out cost the item b words at least, so b <= 2 (1 - least) words / 3, and m - b - 1
    pairs are kept. Additions alone cost the item no word; the bound holds for those up to one in
    two words, and for any that leave so many pairs.
    """
    return max(1, math.ceil(least * words - (1 - least) * words / 3 - 1 - 1e-9))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the words of ``text`` it spans, [start, end).

    A row of the matrix is worked out at once: a gap in the item costs the same for each word, so
    the best way from the left is a running maximum. Unknown words, -1, match nothing.
    """
    n = len(text)
    if not n:
        return 0, 0, 0
    slope = np.arange(1, n + 1, dtype=np.int64) * -GAP
    above, begin_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, best_end, best_start = 0, 0, 0
    places = np.arange(n)
    for word in item.tolist():
        across = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        down = above[1:] + GAP
        here = np.maximum(across, down)
        begin = np.where(across >= down, begin_above[:-1], begin_above[1:])
        fresh = here <= 0
        here[fresh], begin[fresh] = 0, places[fresh] + 1
        lifted = np.maximum.accumulate(here + slope)
        from_left = lifted > here + slope
        if from_left.any():
            source = np.maximum.accumulate(np.where(from_left, -1, places))
            begin = begin[source]
        row = lifted - slope
        above = np.concatenate([[0], row])
        begin_above = np.concatenate([[0], begin])
        top = int(row.argmax())
        if row[top] > best:
            best, best_end, best_start = int(row[top]), top + 1, int(begin[top])
    return best, best_start, best_end


def best_alignment(items: Items, key: int, text: np.ndarray, grams: np.ndarray) -> tuple[int, int, int]:
    """The best alignment of an item with ``text``, within reach of the n-grams they share."""
    at = np.flatnonzero(np.isin(grams, items.grams(items.words[key])) & (grams >= 0))
    return around(items.words[key], text, at)


def around(item: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[int, int, int]:
    """The best alignment within reach of the places ``at``."""
    reach, best = 2 * len(item), (0, 0, 0)
    if not len(at):
        return best
    for run in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1):
        low, high = max(0, int(run[0]) - reach), min(len(text), int(run[-1]) + reach)
        score, start, end = align(item, text[low:high])
        if score > best[0]:
            best = (score, low + start, low + end)
    return best


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = 0.5,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Documents that hold a test item, whole or edited: id, item, ``score``, ``start``, ``end``.

    ``score`` is the best local alignment score over that of the whole item; a row is given for each
    document and item from ``least`` on, with the words [start, end) of the best alignment. Case and
    punctuation don't count. Items under three words, null or empty texts match nothing. Repeated
    documents or items of one id give one row, the best. Empty tables give an empty table. The
    vocabulary of a block of items must stay below two million words, which its size ensures.
    """
    found = row_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, least, block_chars)
    best = F.max(F.struct("score", (-F.col("start")).alias("before"), "end"))
    found = found.groupBy("doc_id", "item").agg(best.alias("b"))
    found = found.select(
        F.col("doc_id").alias(id_col), F.col("item").alias(item_col), F.col("b.score"),
        (-F.col("b.before")).alias("start"), F.col("b.end"),
    )
    return found


def row_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = 0.5,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``leaks`` by row: ``doc_id`` and ``code``, the hash of the row's text, then ``item``, ``score``,
    ``start`` and ``end``. Repeated rows give repeated ones, repeated items count once; an item without
    an id is sought like others, and its ``item`` is null."""
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("code"), F.col(text_col).alias("text")
    ).where("text is not null")
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    tests = written(tests.where("text is not null").distinct(), "benchmark-items")
    found = None
    for block in _blocks_of(tests, block_chars):
        part = _block(docs, block, least)
        found = part if found is None else found.unionByName(part)
    return found


def _blocks_of(tests: DataFrame, most: int, finer: int = 64) -> list[DataFrame]:
    """The items in blocks of about ``most`` characters. They are dealt by hash into many small parts, whose
    sizes, 64 for each block, come to the driver; parts in a row make a block until it would be too large."""
    chars = tests.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = finer * max(1, -(-chars // most))
    own = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    sizes = tests.groupBy(own.alias("part")).agg(F.sum(F.length("text")).alias("n")).collect()
    bounds, size = [0], 0
    for r in sorted(sizes):
        if size and size + r["n"] > most:
            bounds.append(r["part"])
            size = 0
        size += r["n"]
    ends = [*bounds[1:], parts]
    return [tests.where((own >= low) & (own < high)) for low, high in zip(bounds, ends)]


def _block(docs: DataFrame, tests: DataFrame, least: float) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = tests.schema["item"].dataType.simpleString()
    # A block has a bounded number of characters, and so has what the driver gets and sends.
    found = sorted(tests.collect(), key=lambda r: (r["item"] is None, r["text"], str(r["item"])))
    rows = [(i, r["item"], r["text"]) for i, r in enumerate(found)]
    items = Items([(i, text) for i, _, text in rows], least=least)
    names = [key for _, key, _ in rows]

    def note(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in slices(texts):
                take, grams, out = [], [], []
                for at in range(i, j):
                    numbers = items.numbered(words_of(texts[at]))
                    own = items.grams(numbers)
                    own = np.unique(own[items.shared(own) & (own >= 0)])
                    take.append(np.full(len(own), at))
                    grams.append(own)
                    pairs = items.grams(numbers, 2)
                    for key in items.candidates(pairs).tolist():
                        places = items.passages(key, pairs)
                        score, start, end = around(items.words[key], numbers, places)
                        score /= MATCH * len(items.words[key])
                        if score >= least:
                            out.append((at, key, score, start, end))
                n = sum(map(len, grams))
                take += [np.array([r[0] for r in out], np.int64)]
                at = pa.array(np.concatenate(take), pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at)]
                columns.append(pa.array([*np.concatenate(grams).tolist(), *[None] * len(out)], pa.int64()))
                kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                columns += [pa.array([*[None] * n, *(r[k] for r in out)], t) for k, t in enumerate(kinds, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "code", "gram", *fields])

    # A row is an n-gram of a long item that the document holds, or the leak of a short item.
    fields = ["i", "score", "start", "end"]
    kinds = "i int, score double, start int, end int"
    noted = written(docs.mapInArrow(note, f"doc_id {id_type}, code long, gram long, {kinds}"), "benchmark-grams")
    held = noted.where("gram is not null").select("doc_id", "code", "gram")
    short = noted.where("gram is null").select("doc_id", "code", *fields)
    rarity = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    grams = [
        (i, place // SEGMENT, place, int(g))
        for i in items.long
        for place, g in enumerate(items.grams(items.words[i]))
    ]
    seeds = spark.createDataFrame(grams, "i int, segment int, place int, gram long")
    seeds = seeds.join(rarity, "gram")
    by_item = Window.partitionBy("i").orderBy("n", "place")
    by_segment = Window.partitionBy("i", "segment").orderBy("n", "place")
    seeds = seeds.select(
        "i", "gram",
        F.percent_rank().over(by_item).alias("rank"),
        F.row_number().over(by_segment).alias("first"),
    ).where("rank <= 0.5 or first = 1")
    seeds = seeds.select("i", "gram").distinct()

    pairs = held.join(seeds, "gram").select("doc_id", "code", "i").distinct()
    wanted = pairs.groupBy("doc_id", "code").agg(F.collect_set("i").alias("items"))
    wanted = written(wanted.withColumnsRenamed({"doc_id": "d", "code": "c"}), "benchmark-pairs")
    same = docs["doc_id"].eqNullSafe(wanted["d"]) & (docs["code"] == wanted["c"])
    texts = docs.join(wanted, same).select("doc_id", "code", "text", "items")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in range(4))
            for doc, code, text, own in zip(*columns):
                numbers = items.numbered(words_of(text))
                grams = items.grams(numbers)
                for i in own:
                    score, start, end = best_alignment(items, i, numbers, grams)
                    score /= MATCH * len(items.words[i])
                    if score >= least:
                        out.append((doc, code, i, score, start, end))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            labels = ["doc_id", "code", "i", "score", "start", "end"]
            arrays = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=labels)

    scored = texts.mapInArrow(judge, f"doc_id {id_type}, code long, {kinds}").unionByName(short)
    keys = spark.createDataFrame(list(enumerate(names)), f"i int, item {item_type}")
    return scored.join(keys, "i").drop("i")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark"))
