"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

Hidden states are roles. A line shows a speaker marker (none, a new message without a name, or a
role's name) and features: its length, whether it asks, whether it begins the message. Rates come
from labelled conversations, as counts of bounded tables. Viterbi finds the likeliest roles.

A conversation may be of any length: it is dealt by ranges of turns and cut into blocks. A block's
best scores from each role to each role are a small matrix; these are multiplied within each range, then
along the ranges, and each block is decoded between the roles found for its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cleanlake.llm.shared import table, written

#: Turns in a block; log odds of the role that a marker names; log odds against a change of role
#: without a marker.
BLOCK, NAMED, STEADY = 1_000, 6.0, 12.0
#: Characters after which a block ends before it has as many turns.
CHARACTERS = 4_000_000

# Names that open a line as "name:" and the role each stands for.
NAMES = {
    "user": "user", "human": "user", "q": "user", "question": "user", "prompter": "user",
    "assistant": "assistant", "bot": "assistant", "ai": "assistant", "a": "assistant",
    "answer": "assistant", "gpt": "assistant", "model": "assistant",
    "system": "system", "instruction": "system",
}
_MARKER = re.compile(r"^\s*(?:[#*<>|\[(]+\s*)?([A-Za-z]{1,12})[\])*>|]*\s*:\s*")

FEATURES = 24


def named_role(line: str) -> tuple[str | None, str]:
    """The role that a line's marker names, and the line without the marker."""
    found = _MARKER.match(line)
    role = NAMES.get(found.group(1).lower()) if found else None
    return (role, line[found.end() :]) if role else (None, line)


def feature(line: str, first: bool) -> int:
    """A number below ``FEATURES``: length in doublings, a question, the beginning of a message."""
    size = min(5, len(line.split()).bit_length() // 2 + (len(line) > 400))
    return (size * 2 + ("?" in line)) * 2 + first


@dataclass(frozen=True)
class RoleModel:
    """Log rates: ``start`` by role, ``change`` from role to role, ``shows`` by role and feature."""

    roles: tuple[str, ...]
    start: np.ndarray
    change: np.ndarray
    shows: np.ndarray

    def step(self, marked: bool) -> np.ndarray:
        if marked:
            return self.change
        return np.where(np.eye(len(self.roles), dtype=bool), 0.0, -STEADY)

    def evidence(self, line: str, marked: bool, role: str | None) -> np.ndarray:
        seen = self.shows[:, feature(line, marked)].copy()
        if role in self.roles:
            seen[self.roles.index(role)] += NAMED
        return seen


def read_lines(text: str | None) -> list[tuple[str, bool, str | None]]:
    """(line, whether a message begins here, role its marker names) of one turn's text. A turn
    begins a message; null and empty texts are one empty line."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        role, bare = named_role(line)
        out.append((bare, i == 0 or role is not None, role))
    return out


def _best(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(max, +) product of a matrix or vector with a step."""
    return (scores[..., :, None] + step).max(axis=-2)


def block_matrix(model: RoleModel, texts: list[str | None]) -> np.ndarray:
    """Best score from the role before the block to the role of its last line."""
    n = len(model.roles)
    scores = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
    for text in texts:
        for line, marked, role in read_lines(text):
            scores = _best(scores, model.step(marked)) + model.evidence(line, marked, role)
    return scores


def decode(model: RoleModel, texts: list[str | None], enter: np.ndarray, leave: int, opens: bool):
    """The role of each line of each text. ``enter``: scores of the roles before the block, or, where
    the conversation ``opens`` here, of its first line; ``leave``: the role of the last line."""
    scores, back, lines = enter, [], []
    for at, text in enumerate(texts):
        for line, marked, role in read_lines(text):
            if opens and not back:
                back.append(np.zeros(len(model.roles), int))
                scores = scores + model.evidence(line, marked, role)
            else:
                both = scores[:, None] + model.step(marked)
                back.append(both.argmax(axis=0))
                scores = both.max(axis=0) + model.evidence(line, marked, role)
            lines.append((at, line, marked))
    roles, state = [], leave
    for pointer in reversed(back):
        roles.append(state)
        state = int(pointer[state])
    return [(at, line, marked, model.roles[r]) for (at, line, marked), r in zip(lines, reversed(roles))]


def render(role: str, lines: list[str]) -> str:
    body = "\n".join(lines).strip()
    return f"<|im_start|>{role}\n{body}<|im_end|>"


def learn(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> RoleModel:
    """Rates from labelled turns (null roles are left out), each count raised by one. Without any
    labels the roles are user and assistant, all changes alike."""
    rows = turns.where(F.col(role).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    steps = _steps(rows)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            for own, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line, marked, _ in read_lines(words):
                    key = (own, feature(line, marked))
                    counts[key] = counts.get(key, 0) + 1
        columns = [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]
        types = [pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["role", "feature", "n"]
        )

    shown = rows.select("role", "text").mapInArrow(features, "role string, feature int, n long")
    shown = shown.groupBy("role", "feature").agg(F.sum("n").alias("n")).collect()
    roles = tuple(sorted({role for _, role in steps})) or ("assistant", "user")
    at = {r: i for i, r in enumerate(roles)}
    start, change = np.ones(len(roles)), np.ones((len(roles), len(roles)))
    for (before, own), n in steps.items():
        if before is None:
            start[at[own]] += n
        else:
            change[at[before], at[own]] += n
    shows = np.ones((len(roles), FEATURES))
    for r in shown:
        shows[at[r["role"]], r["feature"]] += r["n"]
    return RoleModel(
        roles,
        np.log(start / start.sum()),
        np.log(change / change.sum(axis=1, keepdims=True)),
        np.log(shows / shows.sum(axis=1, keepdims=True)),
    )


def _ordered(rows: DataFrame, *kept: str) -> DataFrame:
    """``key`` (the conversation as text), ``kept``: dealt by ranges in the order of conversation, turn (null
    first) and hash of the text, so that no conversation, and no turn of one, must fit in a task."""
    rows = rows.withColumns({
        "key": F.to_json(F.struct(F.col("conv").alias("c"))), "code": F.xxhash64("text"),
        "any": F.monotonically_increasing_id(),
    })
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("code"), F.col("any")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", *kept)


def _steps(rows: DataFrame) -> dict[tuple[str | None, str], int]:
    """How often each role follows each, or opens a conversation (None). Tasks count what they have;
    their first and last rows come to the driver, two of each, and are put together there."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts, first, key, last = TaskContext.get().partitionId(), {}, None, None, None
        for batch in batches:
            for own, role in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is None:
                    first = (own, role)
                else:
                    pair = (last if own == key else None, role)
                    counts[pair] = counts.get(pair, 0) + 1
                key, last = own, role
        if first is not None:
            rows = [(part, 0, None, *pair, n) for pair, n in counts.items()]
            rows += [(part, 1, first[0], None, first[1], 1), (part, 2, key, None, last, 1)]
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "key", "before", "role", "n"])

    schema = "part int, kind int, key string, before string, role string, n long"
    found = _ordered(rows, "role").mapInArrow(count, schema).collect()
    out: dict[tuple[str | None, str], int] = {}
    key = last = None
    for r in sorted(found, key=lambda r: (r["part"], r["kind"])):
        if r["kind"] == 0:
            pair, n = (r["before"], r["role"]), r["n"]
        elif r["kind"] == 1:
            pair, n = (last if r["key"] == key else None, r["role"]), 1
        else:
            key, last = r["key"], r["role"]
            continue
        out[pair] = out.get(pair, 0) + n
    return out


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first ``keys`` columns; the input is sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def _blocks(rows: DataFrame, most: int, conv_type: str, turn_type: str) -> DataFrame:
    """Turns in order, at most ``most`` of one conversation in a row: ``part`` and ``seq`` number the
    rows, ``turns`` and ``texts`` are lists."""
    conv_arrow, turn_arrow = (to_arrow_type(rows.schema[c].dataType) for c in ("conv", "turn"))
    types = [pa.int32(), pa.int64(), pa.string(), conv_arrow, pa.list_(turn_arrow), pa.list_(pa.string())]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, size = TaskContext.get().partitionId(), 0, None, 0

        def row():
            values = [part, seq, now[0], now[1], turns, texts]
            arrays = [pa.array([v], t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "key", "conv", "turns", "texts"])

        turns: list = []
        texts: list = []
        for batch in batches:
            for key, conv, turn, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or key != now[0] or len(turns) >= most or size >= CHARACTERS:
                    if now is not None:
                        yield row()
                        seq += 1
                    now, turns, texts, size = (key, conv), [], [], 0
                turns.append(turn)
                texts.append(text)
                size += len(text or "")
        if now is not None:
            yield row()

    schema = f"part int, seq long, key string, conv {conv_type}, turns array<{turn_type}>, texts array<string>"
    return written(_ordered(rows, "conv", "turn", "text").mapInArrow(cut, schema), "chat-blocks")


def follow(squares: list, opened: list, enter: np.ndarray, leave: int | None, opens: bool):
    """Scores before each of the matrices in a row, and the role at the end of each.

    ``enter``: scores before the first; if the conversation ``opens`` with it, ``opened[0]`` are the
    scores behind it. ``leave``: the role at the end of the last one, None for the likeliest.
    """
    enters, scores = [], enter
    for k, square in enumerate(squares):
        enters.append(scores)
        scores = opened[0] if opens and k == 0 else _best(scores, square)
    leaves = [int(scores.argmax()) if leave is None else leave]
    for square, before in zip(reversed(squares[1:]), reversed(enters[1:])):
        leaves.append(int((before + square[:, leaves[-1]]).argmax()))
    return enters, leaves[::-1]


def format_chats(
    turns: DataFrame, model: RoleModel, conv: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """Rows of ``conv``, ``turn``, ``part``, ``role_pred`` and ``rendered``: the messages of each turn.

    A turn is one message unless markers within it open more; ``part`` numbers them. Turns are taken in
    the order of ``turn``, nulls first, equal ones in the order of their text's hash; repeated rows
    are turns of their own. A null conversation is one of its own. Null and empty texts are empty
    messages. Other columns, the role among them, are not read. A conversation of any length, with any
    turns, is cut by number of rows: no task holds more than a few blocks of it, or their matrices in one
    range of turns.
    """
    conv_type, turn_type = (turns.schema[c].dataType.simpleString() for c in (conv, turn))
    batch_type = to_arrow_type(turns.schema[conv].dataType)
    turn_arrow = to_arrow_type(turns.schema[turn].dataType)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    blocks = _blocks(rows, BLOCK, conv_type, turn_type)
    roles = len(model.roles)
    doubles = pa.list_(pa.float64())

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in batch.column(3).to_pylist():
                # What the block scores if the conversation opens with it: its first line is no change.
                opened = None
                for words in texts:
                    for line, marked, role in read_lines(words):
                        opened = model.start if opened is None else _best(opened, model.step(marked))
                        opened = opened + model.evidence(line, marked, role)
                found.append((block_matrix(model, texts).reshape(-1).tolist(), opened.tolist()))
            matrices, opened = ([f[k] for f in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(matrices, doubles), pa.array(opened, doubles)],
                names=["part", "seq", "key", "matrix", "opened"],
            )

    schema = "part int, seq long, key string, matrix array<double>, opened array<double>"
    measured = blocks.select("part", "seq", "key", "texts").mapInArrow(measure, schema)
    measured = written(measured, "chat-matrices")

    def square(matrix) -> np.ndarray:
        return np.array(matrix).reshape(roles, roles)

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of one conversation in one range as one matrix."""
        now = product = opened = None

        def row():
            arrays = [
                pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.string()),
                pa.array([product.reshape(-1).tolist()], doubles), pa.array([opened.tolist()], doubles),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "key", "matrix", "opened"])

        for batch in batches:
            for part, _, key, matrix, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, key) != now:
                    if now is not None:
                        yield row()
                    now, product, opened = (part, key), square(matrix), np.array(own)
                else:
                    product, opened = _best(product, square(matrix)), _best(opened, square(matrix))
        if now is not None:
            yield row()

    spans = measured.repartition("part").sortWithinPartitions("part", "seq")
    spans = spans.mapInArrow(multiply, "part int, key string, matrix array<double>, opened array<double>")
    # As many rows for a conversation as there are ranges that it lies in.
    spans = spans.repartition("key").sortWithinPartitions("key", "part").select("key", "part", "matrix", "opened")

    def ends(numbers: list[int], enters, leaves, opens: bool) -> list[pa.Array]:
        return [
            pa.array(numbers, pa.int64()),
            pa.array([e.tolist() for e in enters], doubles), pa.array(leaves, pa.int32()),
            pa.array([opens and k == 0 for k in range(len(leaves))], pa.bool_()),
        ]

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), own in _groups(batches, 1):
            squares, opened = [square(r[2]) for r in own], [np.array(r[3]) for r in own]
            enters, leaves = follow(squares, opened, model.start, None, True)
            parts, *rest = ends([r[1] for r in own], enters, leaves, True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own), pa.string()), parts.cast(pa.int32()), *rest],
                names=["key", "part", "enter", "leave", "opens"],
            )

    span_ends = written(
        spans.mapInArrow(chain, "key string, part int, enter array<double>, leave int, opens boolean"), "chat-spans"
    )
    inside = measured.join(span_ends, ["part", "key"]).select(
        "part", "key", "seq", "matrix", "opened", "enter", "leave", "opens"
    )
    inside = inside.repartition("part").sortWithinPartitions("part", "seq")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, _), own in _groups(batches, 2):
            squares, opened = [square(r[3]) for r in own], [np.array(r[4]) for r in own]
            enters, leaves = follow(squares, opened, np.array(own[0][5]), own[0][6], own[0][7])
            numbers, *rest = ends([r[2] for r in own], enters, leaves, own[0][7])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(own), pa.int32()), numbers, *rest],
                names=["part", "seq", "enter", "leave", "opens"],
            )

    block_ends = written(
        inside.mapInArrow(spread, "part int, seq long, enter array<double>, leave int, opens boolean"), "chat-ends"
    )
    joined = blocks.drop("key").join(block_ends, ["part", "seq"])
    joined = joined.select("conv", "turns", "texts", "enter", "leave", "opens")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own, texts, enter, leave, opens in zip(*(c.to_pylist() for c in batch.columns)):
                lines = decode(model, texts, np.array(enter), leave, opens)
                messages: list[list] = []
                for at, line, marked, role in lines:
                    last = messages[-1] if messages else None
                    if last is None or marked or last[0] != at or last[1] != role:
                        part = last[3] + 1 if last and last[0] == at else 0
                        messages.append([at, role, [line], part])
                    else:
                        last[2].append(line)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(messages), batch_type),
                        pa.array([own[m[0]] for m in messages], turn_arrow),
                        pa.array([m[3] for m in messages], pa.int32()),
                        pa.array([m[1] for m in messages], pa.string()),
                        pa.array([render(m[1], m[2]) for m in messages], pa.string()),
                    ],
                    names=["conv", "turn", "part", "role_pred", "rendered"],
                )

    schema = f"conv {conv_type}, turn {turn_type}, part int, role_pred string, rendered string"
    return joined.mapInArrow(write, schema).withColumnsRenamed({"conv": conv, "turn": turn})


def held_out(conv: str = "conv_id") -> Column:
    fold = F.crc32(F.coalesce(F.col(conv).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(fold, F.lit(3)) == 1


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learned from two thirds of the conversations and recovered for all of them."""
    turns = table(spark, sf_dir, "conversations")
    model = learn(turns.where(~held_out()))
    out = format_chats(turns.select("conv_id", "turn", "text"), model)
    return out.withColumn("held_out", held_out())
