"""The benchmark from end to end on a small catalogue, with a policy of one's own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestock.model import ConstraintSpec
from lodestock.operators.benchmark import Benchmark

REGISTRY = [ConstraintSpec("max", "price", "lte", sampling_values=["10", "20"]), ConstraintSpec("brand", "brand", "eq", sampling_values=["red", "Blue & Co"])]
TASKS = "task_id string, difficulty string, infeasible boolean, user_profile struct<hard_constraints: map<string,string>>, ingested_at timestamp"


@pytest.fixture(scope="module")
def made(spark):
    catalog = spark.createDataFrame([(1, 5.0, "red", 9, "x"), (2, 15.0, "red", 1, "x"), (3, 25.0, "blue & co", 5, None), (4, None, "red", 7, "y"), (5, float("nan"), None, 8, "y")], "pid0 int, price double, brand string, pop int, pid string")
    at = dt.datetime(2024, 1, 1)
    rows = [
        ("t1", "easy", False, ({"max": " 20.0 ", "brand": "RED"},), at), ("t2", "hard", None, ({"brand": "blue & co", "max": "10"},), at), ("t3", "hard", True, ({"brand": "Blue & Co", "max": "10"},), at),
        ("t4", None, False, (None,), at), ("t5", "easy", False, ({"brand": "any", "nope": "1", "max": None},), at), ("t1", "easy", False, ({"max": "10"},), at - dt.timedelta(1)), (None, "easy", False, ({},), at),
    ]
    return Benchmark(catalog, spark.createDataFrame(rows, TASKS), REGISTRY, product="pid0", price="price", popularity="pop")


def test_cheapest(made):
    got = {r.task_id: (r.pool_size, r.n, r.csr, r.reward) for r in made.run("cheapest", 2).collect()}
    assert got == {"t1": (2, 2, 1.0, 1.0), "t2": (0, 0, 1.0, 0.0), "t3": (0, 0, 1.0, 1.0), "t4": (5, 2, 1.0, 1.0), "t5": (5, 2, 1.0, 1.0)}


def test_popular_breaks_constraints(made):
    got = {r.task_id: (r.n, round(r.csr, 4), round(r.reward, 4)) for r in made.run("popular", 2).collect()}
    # Products 1 and 5 are the most popular: only the first is red and cheap.
    assert got["t1"] == (2, 0.5, 1.0) and got["t4"] == (2, 1.0, 1.0) and got["t2"] == (2, 0.0, 0.0)


def test_a_policy_of_ones_own(made):
    def first(run, k):
        return run.sets.select("set_id").withColumns({"pos": F.lit(1), "pid": F.lit(2)})

    table = {(r.policy, r.difficulty): r for r in made.report({"first": first, "cheapest": lambda run, k: first(run, k).limit(0)}).collect()}
    assert table["first", None].n_tasks == 5 and table["first", "hard"].n_empty == 2 and table["cheapest", "easy"].reward == 0.0
    assert table["first", "easy"].csr == 1.0 and table["first", "(none)"].reward == pytest.approx(0.75)


def test_empty(spark, made):
    none = Benchmark(made._run.products.limit(0).withColumnRenamed("popularity", "pop").withColumn("brand", F.lit("x")), made.tasks.select("task_id", "difficulty", "infeasible", F.struct(F.create_map(F.lit("brand"), F.lit("red")).alias("hard_constraints")).alias("user_profile"), F.current_timestamp().alias("ingested_at")), REGISTRY, product="pid", price="price", popularity="pop")
    assert {r.pool_size for r in none.run("cheapest").collect()} == {0}
