import random

import pytest

from cleanlake.operators.fixpoint import SEED, ForeignKey, cascade_to_fixpoint
from cleanlake.plans.staging import Staging


@pytest.fixture
def staging(spark, tmp_path):
    return Staging(spark, str(tmp_path))


def plain(tables, rules, seeds):
    """Breadth first over the rows of dictionaries of lists of dictionaries."""
    found = {(t, i): (0, SEED) for t, ids in seeds.items() for i in ids if any(r["id"] == i for r in tables[t])}
    new, depth = set(found), 0
    while new:
        depth += 1
        reached = {}
        for rule in rules:
            keys = [
                tuple(r[p] for p in rule.keys.values()) for r in tables[rule.parent] if (rule.parent, r["id"]) in new
            ]
            keys = {k for k in keys if None not in k}
            for r in tables[rule.child]:
                if all(r[c] == v for c, v in rule.where.items()) and tuple(r[c] for c in rule.keys) in keys:
                    if r["id"] is not None and (rule.child, r["id"]) not in found:
                        reached.setdefault((rule.child, r["id"]), (depth, rule.label))
        found |= reached
        new = set(reached)
    return found


def run(spark, staging, tables, rules, seeds):
    frames = {
        t: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in rows[0])) for t, rows in tables.items()
    }
    ids = {t: spark.createDataFrame([(i,) for i in own], "id long") for t, own in seeds.items()}
    found = cascade_to_fixpoint(frames, rules, ids, staging)
    return {(t, r["id"]): (r["depth"], r["rule"]) for t, rows in found.items() for r in rows.collect()}


def test_cycles_chains_and_several_rules(spark, staging):
    chance = random.Random(2)
    some = lambda n: chance.choice([None, *range(n)])
    tables = {
        "a": [{"id": i, "up": some(60), "b": some(60), "kind": chance.randrange(3)} for i in range(60)],
        "b": [{"id": i, "x": some(8), "y": some(8)} for i in range(60)],
        "c": [{"id": i or None, "x": some(8), "y": some(8), "a": some(60)} for i in range(80)],
    }
    rules = [
        ForeignKey("a", "a", {"up": "id"}, {"kind": 1}),
        ForeignKey("a", "b", {"b": "id"}, name="a goes with b"),
        ForeignKey("c", "b", {"x": "x", "y": "y"}),
        ForeignKey("c", "a", {"a": "id"}),
        ForeignKey("b", "c", {"x": "a"}),
        ForeignKey("gone", "a", {"x": "id"}),
    ]
    seeds = {"a": [0, 1, 1, 99], "b": [7], "gone": [1]}
    want = plain(tables, rules[:5], {t: s for t, s in seeds.items() if t in tables})
    assert max(d for d, _ in want.values()) > 2
    assert run(spark, staging, tables, rules, seeds) == want


def test_a_long_chain_and_a_circle(spark, staging):
    """As many rounds as the chain is long; a circle ends by itself."""
    rows = [{"id": i, "up": i - 1} for i in range(1, 13)] + [{"id": 100, "up": 101}, {"id": 101, "up": 100}]
    rules = [ForeignKey("t", "t", {"up": "id"}, name="below")]
    found = run(spark, staging, {"t": rows}, rules, {"t": [1, 100]})
    assert found == {
        **{("t", i): (i - 1, "below" if i > 1 else SEED) for i in range(1, 13)},
        ("t", 100): (0, SEED), ("t", 101): (1, "below"),
    }


def test_nothing_to_begin_with(spark, staging):
    rules = [ForeignKey("t", "t", {"up": "id"})]
    assert run(spark, staging, {"t": [{"id": 1, "up": 1}]}, rules, {"t": [5]}) == {}


def test_no_round_sends_what_earlier_ones_found(spark, staging, conf):
    """A round's own rows may go to all executors, but not the rows known so far, of which there are ever more."""
    wide, deep = 20_000, 6
    conf({"spark.sql.maxBroadcastTableSize": "2m"})
    rows = spark.range(wide * deep).selectExpr("id", f"id - {wide} as up")
    seeds = {"t": rows.where(f"id < {wide}")}
    found = cascade_to_fixpoint({"t": rows}, [ForeignKey("t", "t", {"up": "id"})], seeds, staging)
    assert {(r["depth"], r["count"]) for r in found["t"].groupBy("depth").count().collect()} == {
        (d, wide) for d in range(deep)
    }
