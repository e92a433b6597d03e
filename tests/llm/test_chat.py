import itertools
import random
import re

import numpy as np

from cleanlake.llm import chat
from cleanlake.llm.chat import format_chats, learn, read_lines

TURNS = "conv_id long, turn long, role string, text string"


def talk(rng, conv, n):
    rows, role = [], rng.choice(["system", "user"])
    for t in range(n):
        text = {"system": "You are brief.", "user": f"why is {t} so?", "assistant": "because " * 30}[role]
        rows.append((conv, t, role, text + "\nand a second line"))
        role = "assistant" if role == "user" else "user"
    return rows


def make(spark, rows):
    return spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as conv", "'y' as block", "'z' as part").repartition(3)


def test_viterbi_is_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 3
        model = chat.RoleModel(
            ("assistant", "system", "user"),
            *(np.log(rng.dirichlet(np.ones(k), s)).reshape(s + (k,)) for k, s in ((n, ()), (n, (n,)), (chat.FEATURES, (n,)))),
        )
        texts = ["one?\ntwo", "three", "user: four\nfive"][: rng.integers(1, 4)]
        lines = [x for t in texts for x in read_lines(t)]

        def value(path):
            total = model.start[path[0]]
            for k, (line, marked, role) in enumerate(lines):
                total += model.evidence(line, marked, role)[path[k]]
                if k:
                    total += model.step(marked)[path[k - 1], path[k]]
            return total

        best = max(itertools.product(range(n), repeat=len(lines)), key=value)
        got = chat.decode(model, texts, model.start, best[-1], True)
        assert [model.roles.index(r) for *_, r in got] == list(best)


def test_roles_are_recovered_in_blocks_too(spark, monkeypatch):
    rng = random.Random(1)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randint(1, 9))]
    turns = make(spark, rows)
    model = learn(turns)
    want = {(c, t): role for c, t, role, _ in rows}
    whole = format_chats(turns.drop("role"), model).collect()
    assert {(r.conv_id, r.turn): r.role_pred for r in whole} == want
    monkeypatch.setattr(chat, "BLOCK", 2)
    cut = format_chats(turns, model).collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole))


def plain_roles(model, texts):
    """Viterbi over all lines at once; the role of each turn's first line."""
    scores, back, firsts = None, [], []
    for text in texts:
        for k, (line, marked, role) in enumerate(read_lines(text)):
            if k == 0:
                firsts.append(len(back))
            if scores is None:
                back.append(None)
                scores = model.start + model.evidence(line, marked, role)
            else:
                both = scores[:, None] + model.step(marked)
                back.append(both.argmax(axis=0))
                scores = both.max(axis=0) + model.evidence(line, marked, role)
    path = [int(scores.argmax())]
    for pointer in reversed(back[1:]):
        path.append(int(pointer[path[-1]]))
    path.reverse()
    return [model.roles[path[k]] for k in firsts]


def test_one_conversation_holds_nearly_all_rows(spark, conf, monkeypatch):
    """Repeated and null turns; it lies in all ranges, in blocks of bounded size, and its roles are those
    of one plain pass."""
    rng = random.Random(3)
    conf({"spark.sql.shuffle.partitions": "5"})
    monkeypatch.setattr(chat, "BLOCK", 50)
    rows = []
    for k in range(3_000):
        role = rng.choice(["user", "assistant"])
        text = f"{'why' if role == 'user' else 'because ' * rng.randint(20, 40)} {k}{'?' if role == 'user' else ''}"
        rows.append((7, rng.choice([None, *range(8)]), role, text))
    rows += [r for c in range(20) for r in talk(rng, 100 + c, 4)]
    turns = make(spark, rows)
    model = learn(turns)
    # Counts of steps are those of the whole conversation in one order.
    coded = turns.selectExpr("conv_id", "turn", "role", "text", "xxhash64(text) as code").collect()
    order = sorted(coded, key=lambda r: (str(r.conv_id), r.turn is not None, r.turn or 0, r.code))
    counts = {}
    for before, own in zip([None, *order], order):
        key = (before.role if before and before.conv_id == own.conv_id else None, own.role)
        counts[key] = counts.get(key, 0) + 1
    assert chat._steps(turns.select(turns.conv_id.alias("conv"), "turn", "role", "text")) == counts
    blocks = chat._blocks(turns.select(turns.conv_id.alias("conv"), "turn", "text"), 50, "bigint", "bigint")
    sizes = [(r["part"], len(r["texts"])) for r in blocks.where("conv = 7").collect()]
    assert max(n for _, n in sizes) == 50 and sum(n for _, n in sizes) == 3_000 and len({p for p, _ in sizes}) == 5
    number = lambda text: int(re.search(r"\d+", text)[0])
    found = {number(r.rendered): r.role_pred for r in format_chats(turns, model).collect() if r.conv_id == 7}
    own = [r for r in order if r.conv_id == 7]
    want = plain_roles(model, [r.text for r in own])
    assert found == {number(r.text): w for r, w in zip(own, want)}


def test_markers_and_odd_turns(spark):
    rng = random.Random(1)
    model = learn(make(spark, [r for c in range(30) for r in talk(rng, c, 6)]))
    rows = [
        (1, 0, None, "User: what is it?\nAssistant: it is this\nand that\nHuman: thanks"),
        (2, 0, None, None), (2, 1, None, ""), (2, 1, None, ""),
        (None, None, None, "why is it so?"), (None, 3, None, "because " * 20_000),
    ]
    got = format_chats(make(spark, rows), model).collect()
    first = sorted((r.part, r.role_pred, r.rendered) for r in got if r.conv_id == 1)
    assert [x[1] for x in first] == ["user", "assistant", "user"]
    assert first[1][2] == "<|im_start|>assistant\nit is this\nand that<|im_end|>"
    assert sum(r.conv_id == 2 for r in got) == 3 and sum(r.conv_id is None for r in got) == 2
    assert format_chats(make(spark, []), model).count() == 0
    assert learn(make(spark, [])).roles == ("assistant", "user")


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    out = chat.op10_chat_format(spark, folder).toPandas()
    turns = spark.read.parquet(f"{folder}/conversations.parquet").toPandas()
    both = out.merge(turns, on=["conv_id", "turn"])
    assert len(both) == len(turns)
    unseen = both[both.held_out]
    assert (unseen.role == unseen.role_pred).mean() > 0.95
