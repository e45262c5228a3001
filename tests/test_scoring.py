"""Utility, ranking metrics and roll-ups against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestock.model import Preference
from lodestock.operators import evaluate as E
from lodestock.operators import policies, scoring


def test_weights():
    assert [round(w, 3) for w in scoring.weights(2)] == [0.667, 0.333] and [round(w, 3) for w in scoring.weights(3)] == [0.571, 0.286, 0.143]
    assert scoring.weights(1) == [1.0] and abs(sum(scoring.weights(9)) - 1) < 1e-12


PREFS = [Preference("price", "minimize", priority=1), Preference("word", "match", "RED", priority=2), Preference("tags", "match", "x", priority=3)]


def test_utility(spark):
    df = spark.createDataFrame(
        [(1, 10.0, "red", ["X"]), (2, 20.0, "blue", []), (3, None, None, None), (4, float("nan"), "Red", ["y", None]), (5, 15.0, "N/A", ["x"])], "id int, price double, word string, tags array<string>"
    )
    w = scoring.weights(3)
    got = {r.id: r.utility for r in scoring.score_pool(df, PREFS).collect()}
    want = {1: sum(w), 2: 0.0, 3: 0.0, 4: w[1], 5: w[0] * 0.5 + w[2]}
    assert all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in want.items())
    assert {r.utility for r in scoring.score_pool(df, []).collect()} == {1.0}
    same = scoring.score_pool(df.where("id = 1"), PREFS[:1]).collect()
    assert same[0].utility == 1.0
    assert df.crossJoin(scoring.pool_stats(df, PREFS)).select(scoring.utility(df.crossJoin(scoring.pool_stats(df, PREFS)), PREFS, weight=[1.0]).alias("u")).first().u == 0.0
    empty = scoring.pool_stats(df.limit(0), PREFS).first()
    assert (empty.price_min, empty.price_max, empty.word_max) == (0.0, 0.0, 1.0)
    assert scoring.score_pool(df.limit(0), PREFS).count() == 0


def plain_metrics(recommended, pool):
    seen = list(dict.fromkeys(recommended))
    rel, ideal = [pool.get(p, 0.0) for p in seen], sorted(pool.values(), reverse=True)
    dcg = lambda xs: sum(x / math.log2(i + 2) for i, x in enumerate(xs))
    out = {f"ndcg_{k}": dcg(rel[:k]) / dcg(ideal[:k]) if dcg(ideal[:k]) else 0.0 for k in (1, 3, 5)}
    n = len(seen)
    out["ndcg_n"] = dcg(rel) / dcg(ideal[:n]) if dcg(ideal[:n]) else 0.0
    p = sum(rel) / (n * max(ideal)) if ideal and max(ideal) else 0.0
    r = sum(rel) / sum(ideal) if sum(ideal) else 0.0
    return out | {"graded_precision": p, "graded_recall": r, "graded_f1": 2 * p * r / (p + r) if p + r else 0.0}


def test_ranking_metrics(spark):
    rng = random.Random(1)
    recs, pools = {}, {}
    for t in range(20):
        pools[t] = {f"p{i}": round(rng.random(), 2) for i in rng.sample(range(30), rng.randint(0, 12))}
        recs[t] = [f"p{rng.randrange(30)}" for _ in range(rng.randint(1, 9))]
    pools[0], recs[0] = {"p1": 0.0}, ["p1"]
    r = spark.createDataFrame([(t, i, p) for t, ps in recs.items() for i, p in enumerate(ps, 1)], "task_id int, pos int, pid string")
    u = spark.createDataFrame([(t, p, x) for t, ps in pools.items() for p, x in ps.items()], "task_id int, pid string, utility double")
    got = {x.task_id: x for x in E.ranking_metrics(r, u).collect()}
    assert set(got) == set(recs)
    for t in recs:
        for k, v in plain_metrics(recs[t], pools[t]).items():
            assert math.isclose(got[t][k], v, abs_tol=1e-9), (t, k)
            assert -1e-9 <= got[t][k] <= 1 + 1e-9
    ideal = [sorted(pools[t], key=lambda p: (-pools[t][p], p)) for t in range(1, 20)]
    best = spark.createDataFrame([(t, i, p) for t, ps in enumerate(ideal, 1) for i, p in enumerate(ps, 1)], "task_id int, pos int, pid string")
    assert all(math.isclose(x.ndcg_n, 1.0) for x in E.ranking_metrics(best, u.where("task_id > 0")).collect() if pools[x.task_id] and max(pools[x.task_id].values()) > 0)
    assert E.ranking_metrics(r.limit(0), u).count() == 0


def test_rewards_and_satisfaction(spark):
    u = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.6), (2, "a", 0.5), (3, "a", 0.1), (3, "b", 0.9)], "task_id int, pid string, utility double")
    r = spark.createDataFrame([(1, 1, "b"), (1, 2, "zz"), (2, 1, "a"), (3, 1, "q")], "task_id int, pos int, pid string")
    got = {x.task_id: x.reward for x in E.rewards(r, u).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}
    catalog = spark.createDataFrame([("a",), ("b",), ("q",)], "pid string")
    bad = r.join(u, ["task_id", "pid"], "left_anti")
    csr = {x.task_id: (x.n, x.n_violating, x.csr) for x in E.satisfaction(r, bad, catalog).collect()}
    assert csr == {1: (2, 1, 0.5), 2: (1, 0, 1.0), 3: (1, 1, 0.0)}


def test_roll_ups(spark):
    rows = [(1, "easy", 1, 1.0, True, None), (1, "easy", 2, 0.0, False, 0.5), (2, None, 1, 0.5, True, None)]
    df = spark.createDataFrame(rows, "task_id int, difficulty string, trial int, reward double, ok boolean, ndcg double")
    out = {r.difficulty: r for r in E.by_difficulty(df.fillna("hard"), ["reward"], ["ndcg"]).collect()}
    assert out[None].n_tasks == 3 and out["easy"].ndcg == 0.5 and out["hard"].ndcg == 0.0
    trials = {r.task_id: r for r in E.by_task_over_trials(df, ["reward", "ok"]).collect()}
    assert trials[1].ok == 0.5 and trials[1].best_trial == 1 and trials[2].reward_std is None
    assert E.over_seeds(df.where("trial = 1").withColumn("seed", F.lit(1)), ["reward"]).first().reward_std == 0.0


def test_policies(spark):
    pools = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "c", 0.3)], "task_id int, pid string, utility double")
    hits = spark.createDataFrame([(1, "c", 1.0), (1, "a", 5.0), (1, "x", 9.0)], "task_id int, pid string, score double")
    assert [r.pid for r in policies.oracle(hits, pools, 5).orderBy("pos").collect()] == ["a", "c", "b"]
    assert policies.random_k(pools, 2, 7).collect() == policies.random_k(pools, 2, 7).collect()
    assert policies.proportional({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3} and policies.proportional({}, 3) == {}
    with pytest.raises(ValueError, match="task_id"):
        policies.task_pools(pools, pools.select("task_id"), "pid", {}, max_tasks=1)
    assert policies.task_pools(pools.drop("task_id"), pools.select("task_id").distinct(), "pid", {}, max_tasks=1).count() == 3


def test_elicitation(spark):
    messages = spark.createDataFrame([(1, "What BATTERY life?"), (1, None), (2, "hello")], "task_id int, text string")
    plan = spark.createDataFrame([(1, "power", "a"), (1, "weight", "b"), (1, None, "c"), (2, "power", "a")], "task_id int, trigger string, key string")
    got = {r.task_id: (r.n_keys, r.n_revealed, round(r.completeness, 3)) for r in E.revealed(messages, plan, {"power": ["battery"], "weight": ["heavy"], "none": []}).collect()}
    assert got == {1: (3, 2, 0.667), 2: (1, 0, 0.0)}
    row = spark.range(1).select(E.elicitation(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("x"), E.elicitation(F.array().cast("array<string>"), F.array(F.lit("b"))).alias("y")).first()
    assert (row.x, row.y) == (0.5, 1.0)
