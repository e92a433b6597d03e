"""Quality by weak supervision.

Rules over surface features vote good, vote bad or abstain. Expectation-maximisation over the
table of vote patterns estimates how often each rule is right about good and about bad documents,
without labels. A document is kept if its posterior probability of being good is high enough, so
one failing rule no longer decides alone. The table of patterns has at most 3 ** rules rows.

Only DataFrame functions are used; a text is read once and never leaves its row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm.shared import BLANK_CHARS, BLANKS, let, table, written

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Votes ``vote`` (1 good, -1 bad) where ``when`` holds and abstains elsewhere. ``belief``: how
    often its votes are taken to be right before the data are seen."""

    name: str
    vote: int
    when: str
    belief: float


RULES = (
    Rule("short", -1, "n_words < 10", 0.95),
    Rule("odd_words", -1, "word_chars < 2 * n_words or word_chars > 16 * n_words", 0.95),
    Rule("symbols", -1, "n_words > 0 and 10 * n_symbols >= n_words", 0.95),
    Rule("repeats", -1, "n_words > 0 and 5 * n_repeat_words > n_words", 0.95),
    Rule("lines", -1, "n_text_lines > 4 and 10 * n_dup_lines >= 3 * n_text_lines", 0.95),
    Rule("capitals", -1, "n_words > 0 and 2 * n_capitals >= word_chars", 0.95),
    Rule("monotony", -1, "n_words >= 20 and 10 * n_distinct <= n_words", 0.9),
    Rule("shouting", -1, "n_words > 0 and 2 * n_stops >= n_words", 0.8),
    Rule("prose", 1, "n_stops > 0 and 50 * n_symbols <= n_words and n_dup_lines = 0 "
                     "and 5 * n_capitals <= word_chars and 3 * n_stops <= n_words", 0.8),
    Rule("unrepeated", 1, "n_words >= 30 and n_repeat_words = 0 and 50 * n_symbols <= n_words", 0.8),
)


def _windows(hashes: Column) -> Column:
    """A hash for each window of ``WINDOW`` words, in order."""
    n = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(hashes, k + 1, n) for k in range(WINDOW)])
    return F.transform(shifted, lambda w: F.xxhash64(w))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: neighbours in sorted order are equal."""

    def count(placed: Column) -> Column:
        again = F.filter(
            placed,
            lambda x, i: F.get(placed, i - 1)["h"].eqNullSafe(x["h"])
            | F.get(placed, i + 1)["h"].eqNullSafe(x["h"]),
        )
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), steps)

    def steps(at: Column) -> Column:
        # A window adds as many words as it lies behind the one before, five at most.
        n = F.greatest(F.size(at) - 1, F.lit(0))
        gaps = F.zip_with(
            F.slice(at, 2, n), F.slice(at, 1, n), lambda b, a: F.least(F.lit(WINDOW), b - a)
        )
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    placed = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows), let(placed, count)
    ).otherwise(F.lit(0))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row of ``docs``: the id and what the rules look at.

    Words are runs of characters other than blanks. A null text has no words and counts 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.trim(text, F.lit(BLANK_CHARS)), f"[{BLANKS}]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda l: F.trim(l, F.lit(BLANK_CHARS)) != "")

    def stripped(pattern: str) -> Column:
        return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))

    of_words = let(
        hashes,
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
            let(_windows(h), _covered).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda l: F.struct(
            F.size(l).cast("long").alias("n_text_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        ),
    )
    return docs.select(
        F.col(id_col).alias("doc_id"),
        of_words.alias("_words"),
        of_lines.alias("_lines"),
        (F.char_length(text) - stripped(f"[{BLANKS}]+")).cast("long").alias("word_chars"),
        stripped(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        stripped(r"[\p{Lu}!]").cast("long").alias("n_capitals"),
        stripped(r"[.!?]").cast("long").alias("n_stops"),
    ).select("doc_id", "_words.*", "_lines.*", "word_chars", "n_symbols", "n_capitals", "n_stops")


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [
        F.when(F.expr(r.when), r.vote).otherwise(0).alias(r.name) for r in rules
    ]


@dataclass(frozen=True)
class LabelModel:
    """``right[r]``: how often the votes of rule r are right; ``prior``: share of good documents."""

    prior: float
    right: tuple[float, ...]

    def weights(self) -> list[float]:
        """Log odds that a vote adds in its direction."""
        return [math.log(a / (1 - a)) for a in self.right]

    def log_odds(self, vote: tuple[int, ...]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        return odds + sum(v * w for v, w in zip(vote, self.weights()))


def fit(
    patterns: list[tuple[tuple[int, ...], int]],
    rules: tuple[Rule, ...] = RULES,
    prior: float = 0.7,
    rounds: int = 200,
) -> LabelModel:
    """Expectation-maximisation over (votes, documents).

    The share of good documents is given, as votes alone cannot tell it from the rules' rates.
    What is believed of a rule weighs as much as all its votes: where no other rule votes, belief
    decides; where others vote, they confirm or weaken it. Accuracies stay in [0.5, 0.99], so
    no rule is turned round. A rule without votes keeps its belief.
    """
    model = LabelModel(prior, tuple(r.belief for r in rules))
    for _ in range(rounds):
        seen, right = [0] * len(rules), [0.0] * len(rules)
        for vote, n in patterns:
            good = 1 / (1 + math.exp(-model.log_odds(vote)))
            for r, v in enumerate(vote):
                if v:
                    seen[r] += n
                    right[r] += n * (good if v > 0 else 1 - good)
        new = tuple(
            min(0.99, max(0.5, (rule.belief + x / n) / 2)) if n else rule.belief
            for rule, n, x in zip(rules, seen, right)
        )
        if max((abs(a - b) for a, b in zip(new, model.right)), default=0) < 1e-9:
            break
        model = LabelModel(prior, new)
    return model


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    least: float = 0.5,
) -> tuple[DataFrame, LabelModel]:
    """Features, ``base_failed``, ``posterior`` and ``kept`` of every row, and the model.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated windows. Such rows
    are never kept and take part in the estimate. Null and empty texts fail. Rows are judged one
    by one, so repeated rows and ids do no harm; an empty table gives an empty table.
    """
    rows = written(features(docs, id_col, text_col), "quality")
    names = [r.name for r in rules]
    counted = rows.select(*votes(rules)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    patterns = [(tuple(r[k] for k in names), r["n"]) for r in counted.collect()]
    model = fit(sorted(patterns), rules)

    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for vote, weight in zip(votes(rules), model.weights()):
        odds = odds + vote * F.lit(weight)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)), model


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior",
    )
