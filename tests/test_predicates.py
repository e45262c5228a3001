"""Each operator on hand-made rows: filter and mask agree, nulls behave as stated."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestock.model import ConstraintSpec
from lodestock.operators import predicates as P

NAN = float("nan")
ROWS = [
    (1, 5.0, "SSD", ["HDMI", "usb"], True, "5", dt.datetime(2020, 1, 1)),
    (2, NAN, "ssd", [], False, "x", dt.datetime(2021, 1, 1)),
    (3, None, None, None, None, None, None),
    (4, 9.0, "", [None], True, "9", dt.datetime(2019, 5, 5)),
    (5, 1.0, "N/A", ["USB", None, "usb"], False, "", dt.datetime(2020, 6, 1)),
]
SCHEMA = "id int, num double, word string, list array<string>, flag boolean, text string, at timestamp_ntz"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


CASES = [
    ("num", "lte", 5, {1, 5}), ("num", "gte", 5, {1, 4}), ("num", "range", (1, 5), {1, 5}), ("num", "gte", "x", set()),
    ("word", "eq", "ssd", {1, 2}), ("word", "eq", "", {3, 4}), ("word", "neq", "ssd", {3, 4, 5}), ("word", "neq", "", {1, 2, 5}),
    ("word", "in_set", ["SSD", "n/a"], {1, 2, 5}), ("word", "in_set", "ssd", {1, 2}), ("word", "eq_any", ["ssd", ""], {1, 2, 3, 4}), ("word", "in_set", [], set()),
    ("word", "substring", "S", {1, 2}), ("word", "substring", "", {1, 2, 3, 4, 5}),
    ("list", "contains", "USB", {1, 5}), ("list", "not_contains", "usb", {2, 4}), ("list", "contains_all", ["usb", "hdmi"], {1}), ("list", "contains_any", ["usb", "x"], {1, 5}),
    ("list", "not_contains_any", ["usb"], {2, 4}), ("list", "not_contains_all", ["usb", "hdmi"], {2, 4, 5}),
    ("list", "contains_all", [], {1, 2, 3, 4, 5}), ("list", "contains_any", [], {1, 2, 3, 4, 5}), ("list", "not_contains_any", [], {1, 2, 3, 4, 5}), ("list", "not_contains_all", [], {1, 2, 3, 4, 5}),
    ("word", "contains", "ssd", set()), ("word", "not_contains", "ssd", set()),
    ("flag", "boolean", "yes", {1, 4}), ("flag", "boolean", False, {2, 3, 5}),
    ("text", "lte", 6, {1}), ("text", "gte", 6, {4}),
    ("at", "gte", "2020-01-01", {1, 2, 5}), ("at", "lte", 1577836800, {1, 4}), ("at", "lte", "never", set()),
]


@pytest.mark.parametrize("column,op,value,want", CASES)
def test_operator(df, column, op, value, want):
    dtype, c = df.schema[column].dataType, F.col(column)
    assert {r.id for r in df.where(P.condition(c, dtype, op, value)).collect()} == want
    marked = df.select("id", P.mask(c, dtype, op, value).alias("m")).collect()
    assert {r.id for r in marked if r.m} == want and all(r.m is not None for r in marked)


@pytest.mark.parametrize("op", ["contains", "contains_any", "contains_all"])
def test_negation_splits_the_non_null_rows(df, op):
    dtype, c = df.schema["list"].dataType, F.col("list")
    value = "usb" if op == "contains" else ["usb", "hdmi"]
    yes = {r.id for r in df.where(P.condition(c, dtype, op, value)).collect()}
    no = {r.id for r in df.where(P.condition(c, dtype, f"not_{op}", value)).collect()}
    assert not yes & no and yes | no == {1, 2, 4, 5}


REG = [ConstraintSpec("max", "num", "lte", "at most {value}"), ConstraintSpec("w", "word", "neq", "not {value}"), ConstraintSpec("has", "list", "contains_any")]


def test_filter_is_monotone_and_warns_of_unknown_names(df):
    one = {r.id for r in P.constraint_filter(df, {"max": 9}, REG).collect()}
    two = {r.id for r in P.constraint_filter(df, {"max": 9, "has": ["usb"]}, REG).collect()}
    assert two <= one
    with pytest.warns(UserWarning):
        assert P.constraint_filter(df, {"nope": 1}, REG).count() == 5


def test_strict_nulls(df):
    assert {r.id for r in P.constraint_filter(df, {"w": "ssd"}, REG).collect()} == {3, 4, 5}
    assert {r.id for r in P.constraint_filter(df, {"w": "ssd"}, REG, strict_nulls=True).collect()} == {4, 5}


def test_violations_are_stricter_than_the_filter(df):
    got = {r.id: r.v for r in df.select("id", P.violations(df, {"max": 5, "w": "ssd"}, REG).alias("v")).collect()}
    assert got[1] == ["word=SSD violates not ssd"]
    assert got[3] == ["num is missing or NA (cannot satisfy constraint 'max')", "word is missing or NA (cannot satisfy constraint 'w')"]
    assert got[5] == ["word is missing or NA (cannot satisfy constraint 'w')"]
    assert got[2][0].startswith("num is missing")


def test_filters_reach_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/part.parquet")
    plan = P.constraint_filter(df, {"s": 10}, [ConstraintSpec("s", "p_size", "lte")])._jdf.queryExecution().toString()
    assert "LessThanOrEqual(p_size,10)" in plan


def test_unknown_operator():
    with pytest.raises(ValueError):
        ConstraintSpec("x", "y", "almost")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.constraint_filter(empty, {"max": 1}, REG).count() == 0
    assert P.row_coverage(empty, ["num"]).count() == 0
