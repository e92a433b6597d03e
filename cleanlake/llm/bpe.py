"""Byte-pair encoding by speculation and verification, and decoding.

A text is cut into words where the pre-tokenizer cuts it. For every new word, greedy longest match over
the vocabulary proposes tokens. A proposal is the encoding exactly if every two neighbours are:
undoing the merges of both tokens, last one first, must show no moment at which a merge across
their border came earlier. That is checked for all neighbours of a batch at once. Words with a pair that
fails are merged exactly, by the ``tokenizers`` library. Words repeat, so results are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm.shared import forget, per_worker, slices, table
from cleanlake.llm.tokens import _OTHER, ChunkEncoder, byte_letters

#: Entries of the encoder's memos; characters that are worked on together.
MEMO, PART = 400_000, 1_000_000
_NEVER = np.int64(1 << 40)


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; none for an id that is not there."""
    file = _read(path)
    vocabulary: dict[str, int] = file["model"]["vocab"]
    byte_of = {ord(letter): byte for byte, letter in byte_letters().items()}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    out = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for letters, i in vocabulary.items():
        if letters not in special:
            out[i] = letters.translate(byte_of).encode("latin-1")
    for content, i in special.items():
        out[i] = content.encode()
    return out


class Merges:
    """The merges of a byte-level vocabulary as arrays: what each token was made of, and when."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        file = _read(path)
        model = file["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.bytes = token_bytes(path)
        size = len(self.bytes)
        # When a token is made, and from what; bytes are there from the beginning.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("a token that two merges make is not supported")
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        code = (left << 32) | right
        order = np.argsort(code)
        self._code, self._when = code[order], order
        # Only tokens that their own bytes are merged into can occur.
        exact = Tokenizer.from_file(path).model.tokenize
        found = [(i, self.bytes[i]) for t, i in vocabulary.items()
                 if t not in self.special and [x.id for x in exact(t)] == [i]]
        self._prefix_tree(found)

    def _prefix_tree(self, tokens: list[tuple[int, bytes]]) -> None:
        """Nodes by number; an edge is found under (node, byte) in a sorted array."""
        edges: dict[int, int] = {}
        token = [-1]
        for i, text in tokens:
            node = 0
            for byte in text:
                at = node << 8 | byte
                node = edges.get(at, 0)
                if not node:
                    node = edges[at] = len(token)
                    token.append(-1)
            token[node] = i
        self._edges = np.array(sorted(edges), np.int64)
        self._targets = np.array([edges[e] for e in self._edges.tolist()], np.int64)
        self._token = np.array(token, np.int64)
        if sum(1 for _, t in tokens if len(t) == 1) != 256:
            raise ValueError("not a byte-level vocabulary")

    def longest(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each byte and ends by ``limit``, and where it ends."""
        token = np.zeros(len(data), np.int64)
        end = np.arange(len(data))
        live, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        depth = 0
        while len(live):
            at = live + depth
            inside = at < limit[live]
            live, node, at = live[inside], node[inside], at[inside]
            edge = node << 8 | data[at]
            place = np.minimum(np.searchsorted(self._edges, edge), len(self._edges) - 1)
            known = self._edges[place] == edge
            live, node = live[known], self._targets[place[known]]
            depth += 1
            found = self._token[node]
            whole = found >= 0
            token[live[whole]] = found[whole]
            end[live[whole]] = live[whole] + depth
        return token, end

    def merged_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When tokens ``a`` and ``b`` merge if they meet."""
        code = (a << 32) | b
        place = np.minimum(np.searchsorted(self._code, code), len(self._code) - 1)
        return np.where(self._code[place] == code, self._when[place], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of each ``a`` and ``b``, joined, are encoded as just these two tokens."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        until = np.full(len(a), _NEVER)
        while len(live):
            crossed = self.merged_at(a, b) < until
            out[live[crossed]] = False
            # Of equal merges the left one comes first, so the right one is undone first.
            in_a, in_b = self.rank[a], self.rank[b]
            of_a = in_a > in_b
            go = ~crossed & (np.maximum(in_a, in_b) >= 0)
            live, of_a, in_a, in_b, a, b = (x[go] for x in (live, of_a, in_a, in_b, a, b))
            until = np.where(of_a, in_a, in_b + 1)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens by longest match, those of all words end to end; how many each word has; and whether
        they are its encoding."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        token, after = self.longest(data, np.repeat(ends, sizes))
        # All words go on by one token at a time.
        found, owner, live, at = [], [], np.arange(len(words)), ends - sizes
        live, at = live[sizes > 0], at[sizes > 0]
        while len(live):
            found.append(token[at])
            owner.append(live)
            at = after[at]
            more = at < ends[live]
            live, at = live[more], at[more]
        none = np.empty(0, np.int64)
        joined, word = (np.concatenate(x) if x else none for x in (found, owner))
        order = np.argsort(word, kind="stable")
        joined, word = joined[order], word[order]
        inner = np.flatnonzero(word[1:] == word[:-1])
        # Neighbours repeat: each two are checked once.
        pairs, which = np.unique(joined[inner] << 32 | joined[inner + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        right = np.ones(len(words), bool)
        right[word[inner[~fine[which]]]] = False
        return joined, np.bincount(word, minlength=len(words)), right


class SpeculativeEncoder(ChunkEncoder):
    """``special``: special tokens in a text become their ids; else their strings are plain text."""

    def __init__(self, path: str, special: bool = True, most: int = MEMO):
        super().__init__(path, "<u4", True, most)
        self.merges = Merges(path)
        self._cut_words = self._tokenizer.pre_tokenizer.pre_tokenize_str
        self._byte_of = {ord(letter): byte for byte, letter in self._letters.items()}
        names = sorted(self.merges.special, key=len, reverse=True) if special else []
        self._special = re.compile("|".join(map(re.escape, names))) if names else None

    def _words(self, text: str) -> list[bytes]:
        """Words of any text, as the library cuts it."""
        byte_of = self._byte_of
        return [w.translate(byte_of).encode("latin-1") for w, _ in self._cut_words(text)]

    def _known(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of at least these words."""
        new = self._pieces.missing(words)
        known = self._pieces.young
        if new:
            tokens, counts, right = self.merges.propose(new)
            data, ends = tokens.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            exact, stored, letters = self._model.tokenize, self._stored, self._letters
            for word, start, end, fine in zip(new, [0, *ends], ends, right.tolist()):
                if fine:
                    known[word] = data[start:end]
                else:
                    found = exact(word.decode("latin-1").translate(letters))
                    known[word] = b"".join([stored[t.id] for t in found])
        return known

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        new = self._chunks.missing(chunks)
        find, cut = self._pattern.findall, []
        odd = set(filter(_OTHER.search, new)) if _OTHER.search("\n".join(new)) else ()
        for chunk in new:
            word = chunk[1:] if chunk[0] == " " else chunk
            if chunk in odd:
                cut.append(self._words(chunk))
            # Letters alone are one piece, and a mark behind them is another.
            elif word.isalpha():
                cut.append([chunk.encode()])
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                cut.append([chunk[:-1].encode(), word[-1].encode()])
            else:
                cut.append([w.encode() for w in find(chunk)])
        get = self._known({w for words in cut for w in words}).__getitem__
        known = self._chunks.young
        for chunk, words in zip(new, cut):
            known[chunk] = b"".join(map(get, words))
        return known

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            parts = self._special.split(text) if self._special else [text]
            marks = self._special.findall(text) if self._special else []
            words = [self._words(part) if part else [] for part in parts]
            get = self._known({w for own in words for w in own}).__getitem__
            ids = [b"".join(map(get, own)) for own in words]
            for k, mark in enumerate(marks):
                ids[k] += self._stored[self.merges.special[mark]]
            out.append(b"".join(ids))
        return out


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", special: bool = True
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens`` and ``ids`` (32-bit little-endian numbers).

    Just what the ``tokenizers`` library returns for the whole text with the byte-level file
    ``tokenizer`` (which every executor has at that path), without tokens added. ``special``: the
    special tokens in a text become their ids, as the library does by default; else they are plain
    text. A null or empty text has no tokens; repeated rows and null ids are rows like others.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("bpe", tokenizer, special)
        encoder = per_worker(key, lambda: SpeculativeEncoder(tokenizer, special))
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(texts.to_pylist(), PART):
                ids = encoder.encode(texts.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids binary")
    return rows.withColumnRenamed("doc_id", id_col)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of their ids, special tokens included, as column ``text_col``.

    Bytes that are not UTF-8 become U+FFFD. Null ids give a null text, no ids an empty one; an id that the
    vocabulary lacks adds nothing, as in the library. ``text_col`` replaces a column of that name.
    """
    rows = rows.drop(text_col)
    kept = [F.lit(0).alias("_none"), *[c for c in rows.columns if c != ids_col]]
    packed = rows.select(F.struct(*kept).alias("kept"), F.col(ids_col).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table_ = token_bytes(tokenizer)
        size = len(table_)
        for batch in batches:
            texts = []
            for data in batch.column("ids").to_pylist():
                if data is not None:
                    ids = np.frombuffer(data, "<u4")
                    if len(ids) and int(ids.max()) >= size:
                        ids = ids[ids < size]
                    data = b"".join([table_[i] for i in ids.tolist()]).decode("utf-8", "replace")
                texts.append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, "_text"])

    schema = packed.schema.simpleString()
    out = packed.mapInArrow(run, schema[len("struct<"):-1] + ",_text:string")
    out = out.select("kept.*", F.col("ids").alias(ids_col), F.col("_text").alias(text_col))
    return out.drop("_none")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they are decoded to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
