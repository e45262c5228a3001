"""Every query with SQL agrees with DuckDB over the whole tables of the small scale."""

import math
import os

import duckdb
import pytest

from lodestock.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings laptops cars games tasks constraint_specs "
    "attribute_specs column_profiles loads canonical_values sampling_targets mix_targets"
).split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return "null"
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f"{float(value):.6g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


def compare(spark, small, queries, oracles, name):
    got = queries[name](spark, small).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'").fetchall()
    con.execute("set timezone = 'UTC'").fetchall()
    want = con.execute(oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees(spark, small, name):
    compare(spark, small, registry.QUERIES, registry.ORACLES, name)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"p3_profile"}))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).limit(1).count() <= 1
