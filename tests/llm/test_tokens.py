import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cleanlake.llm import huffman
from cleanlake.llm.huffman import Decoder, Encoder, code_lengths, read_ids, write_ids
from cleanlake.llm.packing import pack, pack_lengths
from cleanlake.llm.shared import fresh_folder
from cleanlake.llm.tokens import ChunkEncoder
from llm_data import SCHEMA

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
PARTS = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "1", "23", "é", "é", "ß", "İ", "Σ", "日本", "\xa0",
         "\x1c", "\x85", "!", "<|endoftext|>", "<|", "　", "́", ".", "'LL", "ſ", "K", "word", "."]


@pytest.mark.parametrize(("name", "keeps"), [(WORD, False), (BYTE, True)])
def test_chunks_give_the_ids_of_whole_texts(name, keeps, odd_texts):
    path = public_tokenizers.path(name)
    whole, chunks = Tokenizer.from_file(path), ChunkEncoder(path, "<u4", keeps, most=50)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [t for _, t in odd_texts]
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert chunks.encode(texts) == want
    assert chunks.encode(texts) == want, "the memo changes nothing"


@pytest.mark.parametrize(("name", "keeps"), [(WORD, False), (BYTE, True)])
def test_latin_texts_are_cut_together(name, keeps):
    """Apostrophes, runs of blanks and ends of texts are cut as the pattern does, and no chunk is kept."""
    path = public_tokenizers.path(name)
    whole, chunks = Tokenizer.from_file(path), ChunkEncoder(path, "<u2", keeps, most=50)
    parts = ["'", "'s", "'re", "'lla", "'v", "''d", "we", "I", " ", "  ", "\n", "\n\n ", "\t", "\xa0", "\x85", "é", "ßa", "Æ",
             "7", "42", "²", "!", "...", "$$", "_", "ɏ"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert chunks.encode(texts) == want
    assert [chunks.encode([t])[0] for t in texts[:300]] == want[:300]
    assert not chunks._chunks.young and not chunks._chunks.old


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.integers(6, 20))
def test_round_trip(ids, most):
    counts = {i: ids.count(i) for i in set(ids)}
    lengths = code_lengths(counts, most)
    assert all(b <= most for b in lengths.values())
    if len(counts) > 1:
        assert sum(2.0**-b for b in lengths.values()) == 1
    own = np.array(ids, np.int64)
    stream, marks = Encoder(lengths).stream(own)
    assert (Decoder(lengths).ids(stream, marks, len(own)) == own).all()


def test_code_is_optimal():
    rng = random.Random(1)
    for _ in range(50):
        counts = {i: int(rng.paretovariate(0.5)) for i in range(rng.randint(2, 60))}
        lengths, heap, cost = code_lengths(counts, 60), list(counts.values()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert sum(counts[i] * lengths[i] for i in counts) == cost


def ids_of(name, text, end):
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False)
    return [*found.ids, end]


def test_files_hold_all_documents_in_order(spark, docs, odd_texts):
    folder = fresh_folder(spark, "ids")
    write_ids(docs(odd_texts), folder, public_tokenizers.path(WORD), block_tokens=2_000)
    got = [tuple(r) for r in read_ids(spark, folder, with_ids=True).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((i for i, _ in odd_texts), key=lambda i: (i is not None, i))
    want = sorted((str(i), ids_of(WORD, t, 1)) for i, t in odd_texts)
    assert sorted((str(r[0]), list(r[4])) for r in got) == want
    start = 0
    for _, at, n, crc, ids in got:
        assert at == start and n == len(ids)
        assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n


def test_no_documents(spark):
    none, folder = spark.createDataFrame([], SCHEMA), fresh_folder(spark, "ids")
    write_ids(none, folder, public_tokenizers.path(WORD))
    assert read_ids(spark, folder).count() == 0
    assert pack(none, public_tokenizers.path(BYTE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_packing_wastes_less_than_first_fit_would(lengths):
    place = pack_lengths(lengths, 50)
    fill = {}
    for (s, offset), n in sorted(zip(place, lengths)):
        assert offset == fill.get(s, 0)
        fill[s] = offset + n
    assert all(v <= 50 for v in fill.values())
    assert len(fill) <= len(set(s for s, _ in pack_lengths(lengths, 50, passes=0)))
    assert 2 * sum(lengths) > 50 * (len(fill) - 1)


def test_exchanges_empty_a_sequence():
    # Best fit pairs 6 with 4 and leaves 5 + 3 + ... apart; exchanges find the tight packing.
    rng = random.Random(5)
    better = 0
    for _ in range(200):
        lengths = [rng.randint(5, 60) for _ in range(40)]
        few = len({s for s, _ in pack_lengths(lengths, 100)})
        better += few < len({s for s, _ in pack_lengths(lengths, 100, passes=0)})
    assert better > 0


def test_pieces_and_sequences(docs, odd_texts):
    rows = pack(docs(odd_texts), public_tokenizers.path(BYTE), size=64, group=5).collect()
    want = []
    for i, t in odd_texts:
        ids, at, piece = ids_of(BYTE, t, 2), 0, 0
        while at < len(ids):
            n = (len(ids) % 64 or 64) if piece == 0 else 64
            crc = zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            want.append((str(i), piece, at, n, crc))
            at, piece = at + n, piece + 1
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == sorted(want)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64


def test_whole_table(spark):
    out = huffman.op2_token_ids(spark, "/root/testdata/sf0.001")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.count() == texts.count()
    last = out.orderBy("start", ascending=False).first()
    assert last.start + last.n_tokens == out.groupBy().sum("n_tokens").first()[0]
