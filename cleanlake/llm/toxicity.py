"""Toxicity by a weighted lexicon.

Texts are folded first: case, accents, letters that look like Latin ones, and digits and signs that
stand for letters; all else is a space. Entries are beginnings of words and whole words whose
share of toxic documents differs, weighted by log odds. One Aho-Corasick pass finds them. Phrases
around an entry that labelled documents show to be harmless are exceptions: an entry inside one
does not count. The sum of weights, by itself and by length, gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanlake.llm.shared import hash_code, lowest, slices, table, written

#: Labelled documents of each class that are learned from.
SAMPLE_DOCS = 4_000
#: Least log likelihood ratio of an entry: one in a million by chance, as many words are tried;
#: least log odds of one.
SURPRISE, ODDS = 24.0, 1.5
#: Lengths of the beginnings that are tried, besides the whole word.
BEGINNINGS = (4, 5, 6, 7)

# Letters of other scripts, digits and signs, and the Latin letter each stands for.
# i, l and 1 look alike, so all three are folded to i.
LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "i", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "г": "r", "п": "n", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "η": "n", "γ": "y", "σ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "€": "e", "£": "i", "l": "i", "ł": "i", "ø": "o", "đ": "d",
}


def _folded(letter: str) -> str:
    base = unicodedata.normalize("NFKD", letter.lower())[:1]
    base = LOOKS.get(letter.lower(), LOOKS.get(base, base))
    return base if len(base) == 1 and base.isalpha() else " "


class Folder:
    """Letter for letter; marks that combine with the letter before them vanish."""

    def __init__(self) -> None:
        self.table = np.full(0x10000, 32, "<u4")
        for point in range(0x10000):
            if not 0xD800 <= point < 0xE000:
                letter = chr(point)
                gone = unicodedata.category(letter) in ("Mn", "Cf")
                self.table[point] = 0 if gone else ord(_folded(letter))

    def fold(self, text: str) -> str:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        out = np.where(points < 0x10000, self.table[np.minimum(points, 0xFFFF)], 32)
        return out[out != 0].astype("<u4").tobytes().decode("utf-32-le")


@dataclass(frozen=True)
class Lexicon:
    """``entries``: weight by folded text that begins with a space, and ends with one if it is a
    whole word. ``exceptions``: folded phrases. ``line``: the logistic score's constant and factors."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    line: tuple[float, float, float] = (-5.0, 0.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.folder = lexicon, Folder()
        self.find = ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            self.find.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.find.add_word(phrase, (len(phrase), None))
        if len(self.find):
            self.find.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries that no exception covers; of those that begin at the
        same place only the weightiest."""
        if not len(self.find):
            return []
        found: dict[int, tuple[int, int, float]] = {}
        safe: list[tuple[int, int]] = []
        for last, (size, weight) in self.find.iter(folded):
            start, end = last + 1 - size, last + 1
            if weight is None:
                safe.append((start, end))
            elif start not in found or weight > found[start][2]:
                found[start] = (start, end, weight)
        out = sorted(found.values())
        if safe:
            safe.sort()
            kept, reach, k = [], -1, 0
            for hit in out:
                while k < len(safe) and safe[k][0] <= hit[0]:
                    reach = max(reach, safe[k][1])
                    k += 1
                if hit[1] > reach:
                    kept.append(hit)
            out = kept
        return out

    def measures(self, text: str | None) -> tuple[float, float]:
        """Logs of the weights' sum, and of the sum for 100 words. Both 0 for an empty text."""
        folded = spaced(self.folder.fold(text or ""))
        total = sum(w for _, _, w in self.hits(folded))
        words = max(1, len(folded.split()))
        return math.log1p(max(total, 0.0)), math.log1p(max(100 * total / words, 0.0))

    def score(self, text: str | None) -> float:
        constant, by_sum, by_length = self.lexicon.line
        total, dense = self.measures(text)
        x = constant + by_sum * total + by_length * dense
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def spaced(folded: str) -> str:
    return " " + " ".join(folded.split()) + " "


def _candidates(word: str) -> Iterator[str]:
    yield f" {word} "
    for n in BEGINNINGS:
        if len(word) > n:
            yield " " + word[:n]


def _counts(sample: DataFrame, keys_of) -> DataFrame:
    """(``key``, ``toxic`` documents, ``clean`` documents) over the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_in = keys_of()
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in keys_in(text):
                    counts.setdefault(key, [0, 0])[0 if toxic else 1] += 1
        columns = [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]]
        types = [pa.string(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "toxic", "clean"])

    rows = sample.select("text", "toxic").mapInArrow(run, "key string, toxic long, clean long")
    return rows.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def surprise(toxic: Column, clean: Column, share: float) -> Column:
    """Log likelihood ratio of this split of documents against the general share of toxic ones."""
    total = F.lit(0.0)
    for seen, part in ((toxic, share), (clean, 1 - share)):
        total = total + F.when(seen > 0, 2 * seen * F.log(seen / ((toxic + clean) * part))).otherwise(0.0)
    return total


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(``text``, ``toxic``): at most twice ``most`` texts of each class.

    Labels are chosen by the hash of their id first. An id may have many rows, so its texts, each once, are
    chosen by the hash of both again.
    """
    # A null id meets no document, and would take the places of labels that do.
    given = labels.where("toxic in (0, 1)").where(F.col(id_col).isNotNull())
    given = written(given.select(id_col, "toxic").distinct(), "toxicity-given")
    chosen = lowest(given, "toxic", hash_code(id_col), most)
    chosen = written(chosen.select(id_col, "toxic"), "toxicity-labels")
    rows = docs.select(id_col, F.col(text_col).alias("text")).where("text is not null").join(chosen, id_col)
    rows = rows.select("text", "toxic", hash_code(id_col, "text").alias("place"))
    places = written(rows.select("toxic", "place").distinct(), "toxicity-places")
    taken = lowest(places, "toxic", F.col("place"), most).select("toxic", "place")
    rows = rows.join(F.broadcast(taken), ["toxic", "place"]).dropDuplicates(["toxic", "place"])
    return written(rows.select("text", "toxic"), "toxicity-sample")


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS
) -> Lexicon:
    """A lexicon from ``docs`` and the 0 and 1 in ``toxic`` of ``labels``.

    Learned from the ``most`` labels of each class that are lowest by the hash of their id, and as many
    texts, twice as many at most: a bounded sample, which bounds all that comes to the driver. Null ids,
    labels and texts are left out; a label given twice counts once, and so does a text of an id. An id with
    both labels counts in both classes. Without rows of both classes the lexicon is empty and all
    scores are low.
    """
    sample = _sample(docs, labels, id_col, text_col, most)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()

    def words_in():
        folder = Folder()

        def keys(text: str) -> set[str]:
            return {c for w in set(folder.fold(text).split()) if len(w) > 2 for c in _candidates(w)}

        return keys

    share = n_toxic / (n_toxic + n_clean)
    toxic, clean = F.col("toxic"), F.col("clean")
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    telling = (F.greatest(toxic, clean) >= 3) & (odds >= ODDS) & (surprise(toxic, clean, share) >= SURPRISE)
    found = _counts(sample, words_in).where(telling).select("key", "toxic", odds.alias("odds")).collect()
    weighed = [(r["toxic"] * r["odds"], -len(r["key"]), r["key"], r["odds"]) for r in found]
    entries: dict[str, float] = {}
    stems: set[str] = set()
    beginnings: set[str] = set()
    for _, _, key, odds in sorted(weighed, reverse=True):
        # A word counts once: no entry that begins another one.
        stem = key.rstrip(" ")
        own = {stem[:n] for n in range(2, len(stem) + 1)}
        if stem not in beginnings and not own & stems:
            entries[key] = round(odds, 6)
            stems.add(stem)
            beginnings |= own
    bare = Lexicon(entries)

    def phrases_in():
        matcher = Matcher(bare)

        def keys(text: str) -> set[str]:
            folded, out = spaced(matcher.folder.fold(text)), set()
            for start, end, _ in matcher.hits(folded):
                stop = folded.index(" ", max(end - 1, start + 1))
                after = folded.find(" ", stop + 1)
                before = folded.rfind(" ", 0, start) if start else -1
                if after > 0:
                    out.add(folded[start : after + 1])
                if before >= 0:
                    out.add(folded[before : stop + 1])
            return out

        return keys

    harmless = f"clean >= 3 and clean * {n_toxic} > 8 * toxic * {n_clean}"
    spared = _counts(sample, phrases_in).where(harmless).select("key").collect() if entries else []
    exceptions = frozenset(r["key"] for r in spared)
    judged = Lexicon(entries, exceptions)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(judged)
        for batch in batches:
            rows = [matcher.measures(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in (0, 1)]
            names = ["total", "dense", "toxic"]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=names)

    kind = sample.schema["toxic"].dataType.simpleString()
    found = sample.select("text", "toxic").mapInArrow(
        measure, f"total double, dense double, toxic {kind}"
    )
    rows = [(r["total"], r["dense"], r["toxic"]) for r in found.collect()]
    return Lexicon(entries, exceptions, logistic(sorted(rows)))


def logistic(rows: list[tuple[float, float, int]], ridge: float = 1.0) -> tuple[float, float, float]:
    """Constant and factors of a logistic curve by Newton's method; factors are not negative."""
    data = np.array(rows, float)
    x, y = np.column_stack([np.ones(len(data)), data[:, :2]]), data[:, 2]
    w, use = np.zeros(3), [0, 1, 2]
    while True:
        part, v = x[:, use], np.zeros(len(use))
        penalty = ridge * np.eye(len(use))
        penalty[0, 0] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ v, -50, 50)))
            step = np.linalg.solve(
                (part * (p * (1 - p))[:, None]).T @ part + penalty, part.T @ (y - p) - penalty @ v
            )
            v = v + step
            if np.abs(step).max() < 1e-8:
                break
        below = [u for u, f in zip(use, v) if u and f < 0]
        if not below:
            w[:] = 0
            w[use] = v
            return tuple(float(f) for f in w)
        use.remove(below[0])


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` in 0 to 1 and ``predicted``, 1 from ``least`` on (such columns are
    replaced). Null and empty texts get the score of a text without entries. Every row is
    judged by its whole text alone."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*keep).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    place = keep.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, j in slices(texts):
                found = [matcher.score(t) for t in texts[i:j]]
                part = batch.slice(i, j - i)
                columns = [pa.array(found, pa.float64()), pa.array([int(x >= least) for x in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], names=[*keep, "score", "predicted"]
                )

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(fold, F.lit(4)) == 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = learn(docs, labels.where(~held_out()))
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(texts, lexicon).select("doc_id", "held_out", "score", "predicted")
