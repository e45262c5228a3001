"""The profile against numpy on made tables, and on odd ones."""

import numpy as np
import pytest

from lodestock.operators.quality_profile import drift_reasons, quality_profile, quality_tags


def ks(a, b):
    at = np.unique(np.concatenate([a, b]))
    return float(np.max(np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b))))


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    rows = []
    for load in (1, 2, 3):
        for i in range(400 * load):
            x = float(round(rng.normal(10 + 3 * (load == 3), 2), 1)) if rng.random() > 0.1 * load else (None if i % 2 else float("nan"))
            rows.append((load, x, int(rng.integers(0, 5)), f"AB{i % 7}" if load < 3 else f"{i % 7}-x{i}", bool(i % 3 == 0), "r"))
    rows.append((None, 1.0, 1, "z", True, "r"))
    df = spark.createDataFrame(rows, "load_id long, x double, k int, word string, flag boolean, rows string")
    loads = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 3)], "load_id long, baseline_load_id long")
    return rows, df, loads


def test_numbers_are_exact(made):
    rows, df, loads = made
    got = {(r.load_id, r.column_name): r for r in quality_profile(df, loads).collect()}
    assert {k[0] for k in got} == {1, 2, 3} and len(got) == 15
    data = {n: np.array([r[1] for r in rows if r[0] == n and r[1] is not None and r[1] == r[1]]) for n in (1, 2, 3)}
    for load, x in data.items():
        r = got[load, "x"]
        assert r.n == len(x) and r.n_distinct == len(set(x)) and r.min_number == x.min() and r.max_number == x.max()
        assert np.allclose(r.quantiles, np.percentile(x, [5, 25, 50, 75, 95])) and np.isclose(r.median, np.median(x))
        if load > 1:
            b = data[load - 1]
            assert np.isclose(r.ks, ks(x, b)) and np.isclose(r.outside_share, np.mean((x < b.min()) | (x > b.max())))


def test_strings_and_reasons(made):
    rows, df, loads = made
    out = {(r.load_id, r.column_name): r for r in quality_tags(drift_reasons(quality_profile(df, loads))).collect()}
    assert out[1, "word"].usual_form == "a9" and out[1, "word"].usual_form_share == 1.0 and out[1, "word"].n_distinct == 7
    assert set(out[3, "word"].reasons) == {"form", "uniqueness"}
    assert out[2, "word"].reasons == [] and out[1, "x"].reasons == [] and "constant" in out[1, "rows"].quality_tags


def test_odd_tables(spark, made):
    _, df, loads = made
    assert quality_profile(df.limit(0), loads).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, None, None)], "load_id long, a double, b string")
    out = drift_reasons(quality_profile(nulls, loads)).collect()
    assert len(out) == 4 and all(r.n == 0 and r.null_rate == 1.0 and r.reasons == [] for r in out)
    with pytest.raises(ValueError):
        quality_profile(df, loads, max_cells=2)


def test_exact_integers_decimals_and_times(spark):
    import datetime as dt
    from decimal import Decimal

    big = 2**53
    rows = [(1, big + i, Decimal(i) / 4, Decimal(f"12345678901234567890.000000000{i}"), dt.datetime(2024, 1, 1, microsecond=i), dt.date(2024, 1, 1 + i)) for i in range(3)]
    df = spark.createDataFrame(rows + rows[:1], "load_id long, a long, b decimal(10,2), c decimal(38,10), t timestamp, d date")
    loads = spark.createDataFrame([(1, None)], "load_id long, baseline_load_id long")
    got = {r.column_name: r for r in quality_profile(df, loads).collect()}
    assert {k: r.n_distinct for k, r in got.items()} == dict.fromkeys("abctd", 3)
    assert got["b"].median == 0.125 and got["b"].max_number == 0.5


def test_shares_and_curves_over_many_stretches(spark, monkeypatch):
    """Small stretches and ranges give what large ones give."""
    from lodestock.operators import quality_profile as q

    rng = np.random.default_rng(9)
    rows = [(load, int(rng.integers(0, 40 + 9 * load)), "abcdefgh"[int(rng.integers(0, 5 + load))], float(rng.normal(load, 3))) for load in (1, 2, 3) for _ in range(700)]
    df = spark.createDataFrame(rows, "load_id long, k int, s string, x double")
    loads = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "load_id long, baseline_load_id long")
    whole = {(r.load_id, r.column_name): r for r in quality_profile(df, loads).collect()}
    monkeypatch.setattr(q, "STRETCH", 17)
    monkeypatch.setattr(q, "RANGE_ROWS", 200)
    parts = {(r.load_id, r.column_name): r for r in quality_profile(df, loads).collect()}
    data = {(n, c): np.array([r[i] for r in rows if r[0] == n]) for n in (1, 2, 3) for i, c in ((1, "k"), (2, "s"), (3, "x"))}
    for key, r in parts.items():
        assert (r.n_distinct, r.quantiles, r.n) == (whole[key].n_distinct, whole[key].quantiles, whole[key].n) and r.n_distinct == len(set(data[key].tolist()))
        if key[0] > 1:
            mine, base = data[key], data[key[0] - 1, key[1]]
            if key[1] == "s":
                assert np.isclose(r.share_distance, sum(abs(np.mean(mine == v) - np.mean(base == v)) for v in "abcdefgh") / 2)
            else:
                assert np.isclose(r.ks, ks(mine, base)) and np.isclose(r.ks, whole[key].ks)


def test_clashing_and_odd_column_names(spark):
    rows = [(1, 1, "a", 1.5, [1]), (2, 2, None, None, [2])]
    df = spark.createDataFrame(rows, "load_id long, n int, value string, column double, `a.b` array<int>")
    got = {(r.load_id, r.column_name): r.n for r in quality_profile(df, spark.createDataFrame([(2, 1)], "load_id long, baseline_load_id long")).collect()}
    assert got == {(1, "n"): 1, (1, "value"): 1, (1, "column"): 1, (2, "n"): 1, (2, "value"): 0, (2, "column"): 0}
