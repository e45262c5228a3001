"""Joins by order and exact quantiles against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestock.operators import joins, quantiles

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), at(rng.randint(0, 9000)) if i % 17 else None) for i in range(200)]
    right = [(rng.choice(["a", "a", "b", "c", None]), at(rng.randint(0, 9000)), rng.randint(0, 9)) for _ in range(120)] + [("a", at(100), 5), ("a", at(100), 7)]
    l = spark.createDataFrame(left, "id int, k string, ts timestamp")  # noqa: E741
    r = spark.createDataFrame(right, "k string, ts timestamp, v int")
    got = {x.id: x.v for x in joins.asof_join(l, r, "k", "ts", "ts", ["v"], block="1 hour", strict=strict).collect()}
    assert len(got) == 200
    for i, k, t in left:
        before = [(s, v) for q, s, v in right if k is not None and t is not None and q == k and (s < t if strict else s <= t)]
        assert got[i] == (max(before)[1] if before else None)
    assert joins.asof_join(l.limit(0), r, "k", "ts", "ts", ["v"]).count() == 0
    assert joins.asof_join(l, r.limit(0), "k", "ts", "ts", ["v"]).where("v is not null").count() == 0


def test_intervals(spark):
    rng = random.Random(5)
    points = [(i, rng.choice("ab"), rng.uniform(-50, 50)) for i in range(150)]
    spans = [(i, rng.choice("ab"), x := rng.uniform(-60, 40), x + rng.choice([0, 3, 20, 70])) for i in range(40)]
    p = spark.createDataFrame(points, "pid int, k string, x double")
    s = spark.createDataFrame(spans, "sid int, k string, a double, b double")
    for width in (1.0, 7.5, 500.0):
        got = [(r.pid, r.sid) for r in joins.interval_join(p, s, "k", F.col("x"), F.col("a"), F.col("b"), width).collect()]
        assert sorted(got) == sorted((i, j) for i, k, x in points for j, q, a, b in spans if k == q and a <= x < b)


def test_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, p string")
    b = spark.createDataFrame([(2, "u"), (3, "v"), (None, "w")], "k int, q string")
    assert sorted(map(str, (tuple(r) for r in joins.both_sides(a, b, "k").select("k", "p", "q").collect()))) == sorted(
        map(str, [(1, "x", None), (2, "y", "u"), (3, None, "v"), (None, "z", None), (None, None, "w")])
    )


@pytest.mark.parametrize("ranges", [1, 37])
def test_quantiles(spark, monkeypatch, ranges):
    monkeypatch.setattr(quantiles, "RANGE_ROWS", ranges * 10)
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 50, 900), np.where(rng.random(900) < 0.4, 1.0, rng.normal(0, 5, 900))
    df = spark.createDataFrame([(int(a), float(b), None) for a, b in zip(x, y)], "x int, y double, z double")
    points = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    got = {r.column_name: r for r in quantiles.exact_quantiles(df, {c: F.col(c) for c in "xyz"}, points).collect()}
    assert set(got) == {"x", "y"} and got["x"].n == 900
    assert np.allclose(got["x"].q, np.quantile(x, points)) and np.allclose(got["y"].q, np.quantile(y, points))
    row = quantiles.quantile_row(df, {"y": F.col("y"), "z": F.col("z")}, {"y": [("m", 0.5)], "z": [("none", 0.5)]}).first()
    assert np.isclose(row.m, np.median(y)) and row.none is None
