"""Language identification by cross-parsing.

For each language a suffix automaton is built of a bounded sample of labelled text. A document is
parsed with each of them: the longest match at the current place is a phrase, and the parse goes on
behind it. The language that needs the fewest bits for its phrases, normalised by length, wins: a
phrase is a place in the sample, so one of a larger sample costs more. As matches are read from the
automaton's start on, parsing is one table look-up for a character, and many pieces of text are
parsed side by side.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanlake.llm.shared import forget, hash_code, lowest, slices, table, written

#: Characters of training text for a language, and documents looked at.
SAMPLE_CHARS, SAMPLE_DOCS = 40_000, 200
#: Bits of a phrase besides its place in the sample: its end, or a letter that the sample lacks.
PHRASE_BITS = 6.0
#: A long text is parsed in pieces of so many characters, each from a phrase's beginning.
PIECE = 512

UNKNOWN = "und"


class Alphabet:
    """Codes of the lower-case letters that training text has; 0 is all else, runs of it one."""

    def __init__(self, letters: str):
        self.letters = "".join(sorted(set(letters)))
        self.size = len(self.letters) + 1
        self.codes = np.zeros(0x10000, np.uint8)
        for code, letter in enumerate(self.letters, 1):
            self.codes[ord(letter)] = code

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        return self.codes[np.minimum(points, 0xFFFF)]


def automaton(codes: list[int], size: int) -> np.ndarray:
    """The suffix automaton of ``codes`` as a table: state, code -> next state or -1."""
    links, lengths, edges = [-1], [0], [{}]
    last = 0
    for c in codes:
        state = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = links[p]
        if p >= 0:
            q = edges[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[state] = q
            else:
                clone = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = links[p]
                links[q] = links[state] = clone
        last = state
    out = np.full((len(links), size), -1, np.int32)
    for state, own in enumerate(edges):
        for c, to in own.items():
            out[state, c] = to
    return out


def parser(edges: np.ndarray) -> np.ndarray:
    """The automaton as a parser, flat: entry state * size + code is the next state * size, negated
    and less one where a new phrase begins with the code. One more state, the last, stands for the
    beginning of a text and for codes without an edge from the start, each a phrase by itself:
    whatever follows begins a new one."""
    states, size = edges.shape
    fresh = np.where(edges[0] >= 0, edges[0], states).astype(np.int64) * size
    table = np.where(edges >= 0, edges * size, -1 - fresh)
    # int32 holds the offsets of any automaton of a bounded sample.
    return np.vstack([table, -1 - fresh]).astype(np.int32).reshape(-1)


def phrases(
    codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, parse: np.ndarray, size: int
) -> np.ndarray:
    """How many phrases each piece ``codes[start : start + length]`` is cut into."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = np.full(len(at), len(parse) - size, np.int32)
    cuts = np.zeros(len(at), np.int64)
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for step, n in enumerate(active.tolist()):
        to = parse[state[:n] + codes[at[:n] + step]]
        cut = to < 0
        cuts[:n] += cut
        state[:n] = np.where(cut, -1 - to, to)
    out = np.empty_like(cuts)
    out[order] = cuts
    return out


class Model:
    """``parsers`` by language, over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = "".join(c for c in "".join(samples.values()).lower() if c.isalpha() and ord(c) < 0xFFFF)
        # 255 codes fit a byte; the rarest letters of large scripts count as other characters.
        counts = {c: letters.count(c) for c in set(letters)}
        self.alphabet = Alphabet("".join(sorted(counts, key=lambda c: (-counts[c], c))[:254]))
        self.parsers, self.bits = [], []
        for language in self.languages:
            codes = _squeezed(self.alphabet.encode(samples[language]))
            self.parsers.append(parser(automaton(codes.tolist(), self.alphabet.size)))
            self.bits.append(float(np.log2(max(1, len(codes)))) + PHRASE_BITS)

    def rates(self, texts: list[str | None]) -> np.ndarray:
        """Bits per code, by text and language; infinite for texts without letters."""
        out = np.full((len(texts), len(self.languages)), np.inf)
        known = [i for i, t in enumerate(texts) if t and has_letters(t)]
        if not known or not self.languages:
            return out
        own = [_squeezed(self.alphabet.encode(texts[i])) for i in known]
        sizes = np.array([len(c) for c in own], np.int64)
        codes = np.concatenate(own)
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(own)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = (np.cumsum(sizes) - sizes)[text] + number * PIECE
        lengths = np.minimum(sizes[text] - number * PIECE, PIECE)
        for k, (parse, bits) in enumerate(zip(self.parsers, self.bits)):
            cuts = phrases(codes, starts, lengths, parse, self.alphabet.size)
            out[known, k] = np.bincount(text, cuts, len(own)) * bits / sizes
        return out


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Runs of code 0 as one."""
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[:1] = True
    return codes[keep]


def has_letters(text: str) -> bool:
    if text.isascii():
        return text.upper() != text.lower()
    return any(unicodedata.category(c)[0] == "L" for c in text)


def samples(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs: int = SAMPLE_DOCS,
    chars: int = SAMPLE_CHARS,
) -> dict[str, str]:
    """Bounded training text by language: whole texts of the ``docs`` documents lowest by hash, until
    there are ``chars`` characters. Each language has its own bound; a rare one has what there is.

    Rows that agree in id, text and language are one document, and a null id is like any other."""
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        hash_code(id_col, text_col).alias("code"),
    )
    rows = rows.where("lang is not null and trim(text) <> ''")
    # Distinct codes, so that a mass of copies takes one place and the bound holds.
    codes = written(rows.select("lang", "code").distinct(), "language-codes")
    chosen = lowest(codes, "lang", F.col("code"), docs).select("lang", "code")
    by_code = Window.partitionBy("lang").orderBy("code")
    chosen = chosen.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= docs)
    chosen = written(chosen.drop("place"), "language-sample")
    # No more than ``chars`` of a text can be used, so no more is moved.
    rows = rows.join(F.broadcast(chosen), ["lang", "code"])
    rows = rows.select("lang", "code", F.substring("text", 1, chars).alias("text"))
    rows = rows.groupBy("lang", "code").agg(F.min("text").alias("text"))
    before = F.sum(F.length("text")).over(by_code.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars)
    found: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["code"])):
        found.setdefault(r["lang"], []).append(r["text"])
    joined = {lang: "\n".join(dict.fromkeys(texts))[:chars] for lang, texts in found.items()}
    return {lang: t for lang, t in joined.items() if has_letters(t)}


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replacing such columns).

    ``und`` and 0 for a null text, one without letters, and where nothing was learned. The score
    is 1 less the best language's rate over the runner-up's, so 0 is a tie; with one language it
    is 1. Ties go to the first language by name. Every row is judged by its text alone.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    place = keep.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, j in slices(texts, 2_000_000):
                rates = model.rates(texts[i:j])
                pred, score = [], []
                for row in rates:
                    if not len(row) or not np.isfinite(row).any():
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    best = int(row.argmin())
                    rest = np.delete(row, best)
                    pred.append(model.languages[best])
                    score.append(1 - float(row[best] / rest.min()) if len(rest) else 1.0)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*keep, "lang_pred", "score"],
                )

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(fold, F.lit(3)) == 1


def learn(docs: DataFrame, id_col: str = "doc_id") -> Model:
    return Model(samples(docs.where(~held_out(id_col)), id_col))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"))
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(texts, model).select("doc_id", "held_out", "lang_pred", "score")
