"""Alignment of two tokenizers, against byte offsets compared token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cleanlake.llm import alignment
from cleanlake.llm.shared import table, written
from cleanlake.llm.tokens import byte_letters

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts by the libraries, every pair of tokens by their offsets; no windows, no memo."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=B)
        self.byte_of = {ord(c): b for b, c in byte_letters().items()}

    def a_bytes(self, i):
        return self.a.id_to_token(i).translate(self.byte_of).encode("latin-1")

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return None
        sides = []
        for ids, of in (
            (self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes), (self.b.encode(text), self.b_bytes)
        ):
            parts = [of(i) for i in ids]
            if b"".join(parts) != (" " + text).encode():
                return None
            ends = np.cumsum([len(p) for p in parts]).tolist()
            sides.append(list(zip(ids, [0, *ends], ends)))
        return sides

    def rows(self, texts):
        links, out = [], []
        for text in texts:
            both = self.tokens(text)
            if both is None:
                links.append(None)
                continue
            a, b = both
            links.append([(x, y) for x, s, e in a for y, t, f in b if s < f and t < e])
        counts = Counter(pair for own in links if own for pair in own)
        most = Counter()
        for (_, y), n in counts.items():
            most[y] = max(most[y], n)
        for text, own in zip(texts, links):
            if own is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            a, b = self.tokens(text)
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            groups = [
                "|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in (a, b))
                for low, high in zip([0, *cuts], cuts)
            ]
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            best = sum(counts[p] == most[p[1]] for p in own)
            total = sum(counts[p] for p in own)
            out.append((len(a), len(b), len(groups), len(own), best, total, digest))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found_rows(frame):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    return sorted((tuple(r) for r in frame.select("doc_id", *COLUMNS).collect()), key=key)


def wanted_rows(plain, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    return sorted(((i, *found) for (i, _), found in zip(rows, plain.rows([t for _, t in rows]))), key=key)


def test_texts_of_all_kinds(spark, docs, plain):
    chance = random.Random(11)
    parts = [
        "a", "the ", "ing", " ", "  ", "\n", "\t", "\r\n", "x" * 20, "!!", "0", "2024 ", "日本", "é", "'s ", "<|endoftext|>",
        "</s>", "<0x0A>", "----", " of", "ß", "\x00", "▁", "\U0001f600", "ﬁ", "word ", "words ", "unbelievable ",
    ]
    rows = [(k, "".join(chance.choice(parts) for _ in range(chance.randint(0, 25)))) for k in range(400)]
    want = wanted_rows(plain, rows)
    assert sum(r[1] == 0 for r in want) > 10  # some are not the same bytes on both sides
    # Blocks and partitions of any size give the same.
    for part, partitions in ((alignment.PART, 3), (40, 5)):
        found = alignment.align_tokens(docs(rows).repartition(partitions), A, B, part=part)
        assert found_rows(found) == want


def test_rows_of_all_kinds(spark, docs, odd_texts, plain):
    rows = [r for r in odd_texts if len(r[1] or "") < 10_000]
    assert found_rows(alignment.align_tokens(docs(rows), A, B)) == wanted_rows(plain, rows)
    assert alignment.align_tokens(docs([]), A, B).count() == 0
    assert found_rows(alignment.align_tokens(docs([(1, None), (None, "")]), A, B)) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")
    ]


def test_very_long_text_and_ties(spark, docs, plain):
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    found = found_rows(alignment.align_tokens(docs([(1, long), (2, long)]), A, B))
    assert found[0][1:] == found[1][1:]
    once = found_rows(alignment.align_tokens(docs([(1, long)]), A, B))[0]
    assert found[0][1:6] == once[1:6] and found[0][6] == 2 * once[6] and found[0][7] == once[7]


def test_windows_need_anchors_in_both(plain):
    aligner = alignment.Aligner(A, B)
    text = "the  cat\n sat on-the  mat"
    a, b = aligner.tokens([text])[0]
    at_a, at_b, upto = aligner._cut(a, b, np.array([len(text) + 1]))
    ends = [np.cumsum(sizes[ids]) for sizes, ids in ((aligner._a_sizes, a), (aligner._b_sizes, b))]
    for p, q in zip(at_a[1:], at_b[1:]):
        assert ends[0][p - 1] == ends[1][q - 1]
    assert upto.tolist() == [len(at_a) - 1] and len(at_a) > 4


def test_blocks_do_not_end_with_batches(spark, docs, plain, conf):
    rows = [(k, f"text number {k} of many") for k in range(300)]
    conf({"spark.sql.execution.arrow.maxRecordsPerBatch": "10"})
    frame = docs(rows).select("doc_id", "text").coalesce(1)
    schema = "block long, ids array<long>, " + ", ".join(f"{c} array<long>" for c in alignment._LISTS)
    schema += ", groups_sha256 array<string>, " + ", ".join(f"{c} binary" for c in alignment._DATA)

    def blocks(part):
        found = frame.mapInArrow(alignment._blocks(A, B, part), schema).select("block", "ids").collect()
        assert sorted(i for r in found for i in r["ids"]) == list(range(300))
        assert len({r["block"] for r in found}) == len(found)
        return [len(r["ids"]) for r in found]

    assert blocks(alignment.PART) == [300]
    assert max(blocks(1_000)) > 30  # some 22 characters each
    assert found_rows(alignment.align_tokens(docs(rows), A, B)) == wanted_rows(plain, rows)


def test_blocks_of_empty_texts_are_bounded(spark, conf):
    conf({"spark.sql.execution.arrow.maxRecordsPerBatch": "7000"})
    frame = spark.range(25_000).selectExpr("id as doc_id", "cast(null as string) as text").coalesce(1)
    parts = frame.mapInArrow(
        lambda batches: (
            alignment.pa.RecordBatch.from_pydict({"n": [len(ids)], "m": [len(texts)]})
            for ids, texts in alignment._parts(batches, alignment.PART)
        ),
        "n long, m long",
    )
    assert [tuple(r) for r in parts.collect()] == [(n, n) for n in (10_000, 10_000, 5_000)]


def test_large_rows_lie_in_small_row_groups(spark):
    noise = "unhex(concat_ws('', transform(sequence(1, 15000), i -> sha2(cast(id * 15000 + i as string), 256)))) as data"
    rows = spark.range(40).coalesce(1).selectExpr("id", noise)
    files = [f.removeprefix("file:").replace("///", "/") for f in written(rows, "large", large_rows=True).inputFiles()]
    groups = [g for f in ds.dataset(files).get_fragments() for g in f.row_groups]
    # Rows of 480 KB; by default all of them would be one row group.
    assert sum(g.num_rows for g in groups) == 40
    assert max(g.num_rows for g in groups) <= 20


def test_query_over_whole_table(spark, plain):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 12_000]
    found = alignment.op13_alignment(spark, folder)
    assert found.columns == ["doc_id", *COLUMNS]
    if len(short) == len(rows):
        assert found_rows(found) == wanted_rows(plain, rows)
    else:  # pairs of tokens of long texts are too many for the plain way
        own = alignment.align_tokens(spark.createDataFrame(short, "doc_id long, text string"), A, B)
        assert found_rows(own) == wanted_rows(plain, short)
        assert found.count() == len(rows)
