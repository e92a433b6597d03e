"""Alignment of two tokenizers' ids over the same text, and how often ids meet.

Each text is tokenised as a whole by both. Where a token marked with a space begins in both at the same
byte, both have a token's end there: an anchor. Anchors cut the text into windows, mostly words, and
equal windows of a block (the same ids on both sides) are aligned once: tokens whose bytes overlap are
linked, and shared ends cut groups. Texts are kept as numbers of distinct windows, so a pair of ids
leaves a block once, with its count; corpus-wide counts come back to each block the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm.bpe import token_bytes
from cleanlake.llm.shared import forget, mixed, per_worker, slices, small_batches, table, trimmed, written
from cleanlake.llm.tokens import ChunkEncoder, _Memo

#: Characters of a block, that is, of texts whose windows and pairs are numbered together.
PART = 2_000_000
#: Rows of a block at most, however short their texts.
ROWS = 10_000
#: Characters that are encoded at once. The arrays of this are many times the text's size.
ENCODED = 500_000
#: Entries of the memo of words that each of the two encoders has.
MEMO = 100_000
SPACE = "▁"

_NUMBERS = "n_a long, n_b long, n_groups long, n_links long"


def _spells(table: np.ndarray, sizes: np.ndarray, ids: list[np.ndarray], whole: list[bytes]) -> np.ndarray:
    """Whether the bytes of each list of ids are the given ones. ``table``: the bytes of all ids, end to
    end, and ``sizes`` how many each has."""
    out = np.array([int(sizes[own].sum()) == len(text) for own, text in zip(ids, whole)], bool)
    take = np.flatnonzero(out)
    if len(take):
        joined = np.concatenate([ids[k] for k in take])
        data = np.frombuffer(b"".join([whole[k] for k in take]), np.uint8)
        n = sizes[joined]
        begin = (np.cumsum(sizes) - sizes)[joined] - (np.cumsum(n) - n)
        differ = table[np.arange(len(data)) + np.repeat(begin, n)] != data
        ends = np.cumsum([len(whole[k]) for k in take])
        upto = np.concatenate([[0], np.cumsum(differ)])
        out[take] = np.diff(upto[ends], prepend=0) == 0
    return out


class PlainEncoder(ChunkEncoder):
    """Ids by a byte-level file; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, "<u4", True, MEMO)
        self._tokenizer.encode_special_tokens = True


class PieceEncoder:
    """Ids of whole texts by a sentencepiece model that adds a space in front.

    No piece of the model goes on behind a space that it does not begin with (which is checked), so a text
    with single spaces has the ids of its words in order. Words repeat, so most are looked up.
    """

    def __init__(self, path: str, most: int = MEMO):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a space inside are not supported")
        self._words = _Memo(most)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        split = [
            None if not t or "  " in t or t[0] == " " or t[-1] == " " or SPACE in t else t.split(" ") for t in texts
        ]
        words: set[str] = set()
        for own in split:
            if own:
                words.update(own)
        new = self._words.missing(words)
        known = self._words.young
        known.update(zip(new, self._whole(new)))
        whole = iter(self._whole([t for t, own in zip(texts, split) if own is None]))
        get = known.__getitem__
        return [next(whole) if own is None else b"".join(map(get, own)) for own in split]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode(texts, num_threads=1) if texts else []
        return [pack(f"<{len(ids)}I", *ids) for ids in found]


class Aligner:
    """Both tokenizers and what is known of windows."""

    def __init__(self, path_a: str, path_b: str):
        self._a, self._b = PlainEncoder(path_a), PieceEncoder(path_b)
        sides = (token_bytes(path_a), [self._bytes_of(i) for i in range(self._b.model.get_piece_size())])
        self._a_sizes, self._b_sizes = (np.array([len(x) for x in side], np.int64) for side in sides)
        self._a_spaced, self._b_spaced = (np.array([x.startswith(b" ") for x in side]) for side in sides)
        self.a_bytes, self.b_bytes = (np.frombuffer(b"".join(side), np.uint8) for side in sides)
        # How ids are shown within a group and at the end of its side.
        self._shown_b = 2 * len(sides[0])
        self._shown = [f"{i}{end}" for i in range(len(sides[0])) for end in ",|"]
        self._shown += [f"{i}{end}" for i in range(len(sides[1])) for end in ",;"]

    def _bytes_of(self, i: int) -> bytes:
        piece = self._b.model.id_to_piece(i)
        if self._b.model.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(SPACE, " ").encode()

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text by both; None where there is no text or the bytes differ from it."""
        spaced = [" " + t if t else None for t in texts]
        there = [k for k, t in enumerate(texts) if t]
        of_a = [np.frombuffer(x, "<u4") for x, t in zip(self._a.encode(spaced), texts) if t]
        of_b = [np.frombuffer(x, "<u4") for x in self._b.encode([texts[k] for k in there])]
        whole = [spaced[k].encode() for k in there]
        same = _spells(self.a_bytes, self._a_sizes, of_a, whole) & _spells(self.b_bytes, self._b_sizes, of_b, whole)
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        for k, a, b, fine in zip(there, of_a, of_b, same.tolist()):
            if fine:
                out[k] = (a, b)
        return out

    def _cut(self, a: np.ndarray, b: np.ndarray, text_ends: np.ndarray):
        """Bounds of the windows of texts laid end to end, among tokens of a and b; and how many
        windows end before each text's end."""
        a_end, b_end = np.cumsum(self._a_sizes[a]), np.cumsum(self._b_sizes[b])
        a_start, b_start = (np.concatenate([[0], end[:-1]]) for end in (a_end, b_end))
        anchors = np.intersect1d(
            a_start[self._a_spaced[a]], b_start[self._b_spaced[b]], assume_unique=True
        )
        # A text's beginning is an anchor by itself: both sides begin with a space there.
        anchors = np.append(anchors, a_end[-1])
        return (
            np.searchsorted(a_start, anchors), np.searchsorted(b_start, anchors),
            np.searchsorted(anchors, text_ends),
        )

    def align(
        self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Groups and links of each window, its groups as text, and the links of all as a << 32 | b.

        Windows lie end to end in ``a`` and ``b`` and have ``n_a`` and ``n_b`` tokens; both sides of a
        window have the same bytes.
        """
        a_end, b_end = np.cumsum(self._a_sizes[a]), np.cumsum(self._b_sizes[b])
        a_start, b_start = (np.concatenate([[0], end[:-1]]) for end in (a_end, b_end))
        first = np.searchsorted(b_end, a_start, "right")
        each = np.searchsorted(b_start, a_end, "left") - first
        other = np.arange(each.sum()) + np.repeat(first - np.cumsum(each) + each, each)
        links = np.repeat(a, each).astype(np.int64) << 32 | b[other]
        window = np.repeat(np.arange(len(n_a)), n_a)
        n_links = np.bincount(window, weights=each, minlength=len(n_a)).astype(np.int64)
        # The last token of a group ends where one of the other side does.
        cut_a = b_end[np.searchsorted(b_end, a_end)] == a_end
        cut_b = a_end[np.searchsorted(a_end, b_end)] == b_end
        n_groups = np.bincount(window, weights=cut_a, minlength=len(n_a)).astype(np.int64)
        group_a, group_b = (np.cumsum(cut) - cut for cut in (cut_a, cut_b))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = np.concatenate([2 * a.astype(np.int64) + cut_a, self._shown_b + 2 * b.astype(np.int64) + cut_b])
        parts = list(map(self._shown.__getitem__, shown[order].tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(parts[i:j]) for i, j in zip([0, *ends], ends)]
        return n_groups, n_links, groups, links

    def distinct(
        self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """For each window the number of its tuple of ids, and for each number a window that has it.

        Windows are told apart by 64-bit hashes, and each is then compared with the one that stands for
        its number; should two tuples ever share a hash, the tuples themselves are looked up.
        """
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        code = np.zeros(len(n_a), np.uint64)
        sides = ((a, at_a, n_a), (b, at_b, n_b))
        for salt, (ids, at, n) in enumerate(sides):
            place = np.arange(len(ids)) - np.repeat(at[:-1], n)
            code += np.add.reduceat(mixed((2 * place + salt).astype(np.uint64) << np.uint64(32) | ids), at[:-1])
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        for ids, at, n in sides:
            same = first[number]
            if not np.array_equal(n, n[same]):
                break
            place = np.arange(len(ids)) - np.repeat(at[:-1], n)
            if not np.array_equal(ids, ids[np.repeat(at[same], n) + place]):
                break
        else:
            return number, first
        known: dict[tuple[bytes, bytes], int] = {}
        keys = [
            (a[p:q].tobytes(), b[r:s].tobytes())
            for p, q, r, s in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:])
        ]
        number = np.array([known.setdefault(k, len(known)) for k in keys])
        return number, np.unique(number, return_index=True)[1]

    def block(self, texts: list[str | None]) -> dict:
        """Numbers of each text, distinct windows as lists of numbers of distinct pairs, and the pairs
        with their counts."""
        both = [x for i, j in slices(texts, ENCODED) for x in self.tokens(texts[i:j])]
        trimmed()
        has = [x is not None for x in both]
        held = [x for x in both if x is not None]
        n_a, n_b = (np.array([len(x[k]) if x else 0 for x in both], np.int64) for k in (0, 1))
        counts = np.zeros(len(texts), np.int64)
        number = pieces = lengths = links = np.empty(0, np.int64)
        groups: list[str] = []
        if held:
            a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            sizes = [int(self._a_sizes[x[0]].sum()) for x in held]
            at_a, at_b, upto = self._cut(a, b, np.cumsum(sizes))
            counts[np.flatnonzero(has)] = np.diff(upto, prepend=0)
            number, first = self.distinct(a, b, at_a, at_b)
            sides = []
            for ids, at in ((a, at_a), (b, at_b)):
                n = (at[1:] - at[:-1])[first]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                sides.append((ids[np.repeat(at[first], n) + inside], n))
            (own_a, of_a), (own_b, of_b) = sides
            pieces, lengths, groups, links = self.align(own_a, own_b, of_a, of_b)
        ends = np.cumsum(counts)

        def over_texts(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(values[number])])
            return upto[ends] - upto[ends - counts]

        shown = list(map(groups.__getitem__, number.tolist()))
        digests = []
        for there, end, n in zip(has, ends.tolist(), counts.tolist()):
            text = "".join(shown[end - n : end])[:-1]
            digests.append(hashlib.sha256(text.encode()).hexdigest() if there else "")
        pairs, place = np.unique(links, return_inverse=True)
        often = np.repeat(np.bincount(number, minlength=len(groups)), lengths)
        times = np.bincount(place, weights=often, minlength=len(pairs)).astype(np.int64)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": over_texts(pieces), "n_links": over_texts(lengths),
            "groups_sha256": digests, "counts": counts, "windows": number.astype("<u4").tobytes(),
            "lengths": lengths.astype("<u4").tobytes(), "links": place.astype("<u4").tobytes(),
            "pairs": pairs.tobytes(), "times": times.tobytes(),
        }


_LISTS = ("n_a", "n_b", "n_groups", "n_links", "counts")
_DATA = ("windows", "lengths", "links", "pairs", "times")


def _parts(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of about ``most`` characters and of ``ROWS`` rows at most, whatever batches they
    come in; a longer text makes a part alone."""
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        start, own = 0, batch.column(1).to_pylist()
        for i, text in enumerate(own):
            n = len(text) if text else 0
            if size and size + n > most or len(texts) + i - start == ROWS:
                yield pa.concat_arrays([*ids, batch.column(0).slice(start, i - start)]), texts + own[start:i]
                ids, texts, start, size = [], [], i, 0
            size += n + 1
        ids.append(batch.column(0).slice(start))
        texts += own[start:]
    if texts:
        yield pa.concat_arrays(ids), texts


def _blocks(path_a: str, path_b: str, part: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _parts(batches, part):
            found = aligner.block(texts)
            columns = [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *[pa.array([found[c]], pa.list_(pa.int64())) for c in _LISTS],
                pa.array([found["groups_sha256"]], pa.list_(pa.string())),
                *[pa.array([found[c]], pa.binary()) for c in _DATA],
            ]
            del found
            trimmed()
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", *_LISTS, "groups_sha256", *_DATA])
            number += 1

    return run


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for block, pairs, times in zip(*batch.columns):
            pairs = np.frombuffer(pairs.as_buffer(), "<i8")
            columns = [
                pa.array(np.full(len(pairs), block.as_py(), np.int64)),
                pa.array(np.arange(len(pairs), dtype=np.int32)),
                pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
                pa.array(np.frombuffer(times.as_buffer(), "<i8")),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "a", "b", "times"])


def _with_counts(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """The rows of one block, from its numbers and the corpus-wide counts of its pairs."""
    row = blocks.slice(0, 1).to_pydict()
    row = {k: v[0] for k, v in row.items()}
    place = found["place"].to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], best[place] = found["total"].to_numpy(), found["best"].to_numpy()
    windows, lengths, links = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in _DATA[:3])
    # Sums over the links of each distinct window, then over the windows of each text.
    ends = np.cumsum(lengths)

    def summed(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values[links])])
        own = upto[ends] - upto[ends - lengths]
        upto = np.concatenate([[0], np.cumsum(own[windows])])
        last = np.cumsum(np.array(row["counts"], np.int64))
        return upto[last] - upto[last - np.array(row["counts"], np.int64)]

    ids = blocks["ids"].combine_chunks().flatten()
    return pa.table({
        "doc_id": ids, **{c: pa.array(row[c], pa.int64()) for c in _LISTS[:4]},
        "n_best": summed(best), "count_sum": summed(total),
        "groups_sha256": pa.array(row["groups_sha256"], pa.string()),
    })


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, ``total``, ``best``): how many links each pair of ids has, and whether no other pair of
    the same ``b`` has more. ``pairs`` has ``a``, ``b`` and ``times``."""
    counts = written(pairs.groupBy("a", "b").agg(F.sum("times").alias("total")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    best = (F.col("total") == F.col("most")).cast("int").alias("best")
    return written(counts.join(most, "b").select("a", "b", "total", best), "best-pairs")


def align_tokens(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text",
    part: int = PART,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``
    and ``groups_sha256``.

    ``tokenizer_a`` is a byte-level file of the ``tokenizers`` library and gets a space before the text,
    special tokens as plain text; ``tokenizer_b`` is a sentencepiece model that adds the space itself. Every
    executor has them at these paths. Tokens are linked where their bytes overlap; ``n_best`` counts the
    links whose pair of ids is, over all rows, the most frequent of its b (ties included), and
    ``count_sum`` adds up the frequencies. Null and empty texts, and those of which either side's
    bytes are not the text's, have zeros and an empty digest. Repeated rows count and are returned each;
    null ids are ids like others. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lists = ", ".join(f"{c} array<long>" for c in _LISTS)
    data = ", ".join(f"{c} binary" for c in _DATA)
    blocks = rows.mapInArrow(
        _blocks(tokenizer_a, tokenizer_b, part),
        f"block long, ids array<{id_type}>, {lists}, groups_sha256 array<string>, {data}",
    )
    blocks = written(blocks, "aligned-blocks", large_rows=True)
    pairs = blocks.select("block", "pairs", "times").mapInArrow(
        _pairs, "block long, place int, a int, b int, times long"
    )
    counts = pair_counts(pairs)
    # Both sides are plain shuffles: rows of a pair that is in nearly all blocks are split if need be.
    found = pairs.drop("times").join(counts, ["a", "b"]).select("block", "place", "total", "best")
    both = blocks.drop("pairs", "times").groupBy("block").cogroup(found.groupBy("block"))
    out = both.applyInArrow(
        _with_counts,
        f"doc_id {id_type}, {_NUMBERS}, n_best long, count_sum long, groups_sha256 string",
    )
    return out.withColumnRenamed("doc_id", id_col)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path_a, path_b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    out = align_tokens(docs, path_a, path_b)
    first = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(*first)
