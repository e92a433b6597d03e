"""Speculative byte-pair encoding against the library, text by text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cleanlake.llm import bpe
from cleanlake.llm.shared import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(PATH)


def test_verdicts_on_words_are_exact(library, merges):
    """A proposal passes if, and only if, it is what merging gives; long runs and ties included."""
    chance = random.Random(5)
    words = [bytes(chance.choice(b"aeiothn ") for _ in range(chance.randint(1, 14))) for _ in range(20_000)]
    words += [bytes([b]) * n for b in b"a= -\n" for n in range(1, 90)]
    words += [bytes(chance.randrange(256) for _ in range(chance.randint(1, 9))) for _ in range(5_000)]
    letters = bpe.byte_letters()
    exact = [[t.id for t in library.model.tokenize(w.decode("latin-1").translate(letters))] for w in words]
    joined, counts, right = merges.propose(words)
    ends = np.cumsum(counts).tolist()
    tokens = [joined[i:j].tolist() for i, j in zip([0, *ends], ends)]
    assert [own == want for own, want in zip(tokens, exact)] == right.tolist()
    assert 0.1 < right.mean() < 0.95


def test_longest_match_by_brute_force(merges):
    chance = random.Random(6)
    data = bytes(chance.choice(b" theing") for _ in range(400))
    limit = np.repeat([150, 400], [150, 250])
    token, end = merges.longest(np.frombuffer(data, np.uint8).astype(np.int64), limit)
    known = {text for i, text in enumerate(merges.bytes) if text}
    for at in range(400):
        longest = max(n for n in range(1, limit[at] - at + 1) if data[at : at + n] in known)
        assert (merges.bytes[token[at]], end[at]) == (data[at : at + longest], at + longest)


@pytest.mark.parametrize("special", [True, False])
def test_texts_of_all_kinds(library, special):
    chance = random.Random(7)
    parts = [
        "a", "the", "ing", " ", "  ", "\n", "\t", "x" * 30, "!!", "0", "日本", "é", "'s", "<|endoftext|>", "<|",
        "=", "----", " of", "ß", "\x1c", "İ", "▁", "\x00", "\U0001f600", "é", "A.b",
    ]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 50))) for _ in range(4_000)]
    library.encode_special_tokens = not special
    try:
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    finally:
        library.encode_special_tokens = False
    # A memo that holds next to nothing must make no difference.
    for most in (400_000, 8):
        assert bpe.SpeculativeEncoder(PATH, special, most).encode(texts) == want


def test_rows_of_all_kinds(spark, docs, odd_texts, library):
    found = bpe.decode(bpe.encode(docs(odd_texts), PATH), PATH).collect()
    want = [
        (i, [] if not t else library.encode(t, add_special_tokens=False).ids, t or "") for i, t in odd_texts
    ]
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in found]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in found)
    assert bpe.decode(bpe.encode(docs([]), PATH), PATH).count() == 0


def test_decoding_as_the_library_does(spark, library):
    """Ids in any order, broken characters, ids that the vocabulary lacks, nulls, and other columns."""
    chance = random.Random(8)
    lists = [[chance.randrange(50_257) for _ in range(chance.randint(0, 12))] for _ in range(300)]
    lists += [[50_256, 262, 50_256], [300_000, 262], []]
    rows = [(k, "old", np.array(ids, "<u4").tobytes(), "x") for k, ids in enumerate(lists)]
    frame = spark.createDataFrame([*rows, (-1, "old", None, "x")], "k long, text string, ids binary, kept string")
    found = {r["k"]: r for r in bpe.decode(frame, PATH).collect()}
    assert found[-1]["text"] is None and found[0]["kept"] == "x"
    for k, ids in enumerate(lists):
        want = library.decode([i for i in ids if i < 50_257], skip_special_tokens=False)
        assert found[k]["text"] == want


def test_query_over_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((
            r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        ))
    found = bpe.op12_bpe(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in found.collect()} == want
    assert found.where(F.col("n_tokens").isNull()).count() == 0
