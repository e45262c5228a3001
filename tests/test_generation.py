"""The generation loop, its counters, and costs."""

import random
from collections import Counter

import pytest

from lodestock.model import Bracket, ConstraintSpec
from lodestock.operators import calibrate, evaluate, tasks

REG = [
    ConstraintSpec("price_max", "price", "lte", sampling_values=[5, 10, 20]),
    ConstraintSpec("brand", "brand", "eq", sampling_values=["a", "b", "c"]),
    ConstraintSpec("size_min", "size", "gte", sampling_values=[1, 5, 9]),
]
BRACKETS = [Bracket("medium", 5, 60, 2, target=6), Bracket("small", 10, 120, 1, target=4), Bracket("oc_infeasible", 0, 0, 2, target=2)]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(1, 30)), rng.choice("ab"), rng.randint(0, 10)) for i in range(200)]
    return calibrate.PoolIndex(spark.createDataFrame(rows, "id int, price double, brand string, size int"), REG)


def test_boost():
    assert tasks.constraint_weight(0.4, 0, 4) == 0.4
    assert tasks.constraint_weight(0.4, 1, 10) == pytest.approx(0.6) and tasks.constraint_weight(0.9, 0, 5) == 0.95
    assert tasks.constraint_weight(0.4, 9, 10) == pytest.approx(0.28) and tasks.constraint_weight(0.4, 4, 10) == 0.4


def test_loop_meets_targets(index):
    made, rejected = tasks.generate(index, REG, BRACKETS, random.Random(1))
    assert Counter(t["difficulty"] for t in made) == {b.tier: b.target for b in BRACKETS}
    for t in made:
        b = next(b for b in BRACKETS if b.tier == t["difficulty"])
        assert b.lo <= t["pool_size"] <= b.hi and index.size(t["hard_constraints"]) == t["pool_size"]
    assert tasks.generate(index, REG, BRACKETS, random.Random(1)) == (made, rejected)


def test_loop_stops_at_the_cap_and_counts_reasons(spark, index):
    made, rejected = tasks.generate(index, REG, BRACKETS, random.Random(1), lambda tier, c, n: "no_anchor")
    assert not made and len(rejected) == 12 * 12
    made, rejected = tasks.generate(index, REG, BRACKETS, random.Random(1), lambda tier, c, n: {"initial_query": " Same" if n % 2 else "same "})
    assert len(made) == 1 and len(rejected) == 12 * 12 - 1
    want = Counter(r["reason"] for r in rejected)
    got = tasks.rejection_counts(spark.createDataFrame(rejected))
    assert {r.reason: r.n for r in got.collect()} == want and want["query_duplicate"] > 0


def test_preference_counters_and_costs(spark):
    rows = [([("p", "min"), ("n", "max")],), ([("n", "max"), ("p", "min")],), ([("p", "max")],), ([],), (None,)]
    df = spark.createDataFrame(rows, "attribute_preferences array<struct<attribute string, direction string>>")
    assert {tuple(r) for r in tasks.preference_pairs(df).collect()} == {("p", "min", 2), ("n", "max", 2), ("p", "max", 1)}
    assert {tuple(r) for r in tasks.preference_combos(df).collect()} == {("n:max|p:min", 2), ("p:max", 1)}
    r = spark.createDataFrame([(0.5, 0.25), (1.0, None)], "agent_cost double, user_simulator_cost double")
    assert tuple(evaluate.costs(r).first()) == (1.5, 0.25, 1.75) and tuple(evaluate.costs(r.limit(0)).first()) == (0.0, 0.0, 0.0)
