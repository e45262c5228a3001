"""Column-level data quality profile of the loads of a large table, with drift against a baseline.

Every non-null cell becomes (load, column, value) and equal ones are counted, so a load or a value that
holds a third of all rows is small before anything is sorted. The counts are range-sorted by (column,
value), each partition is read once as a stream, and every stretch of it yields, by load, how many values
and distinct values it holds and, for a load and its baseline, its piece of their cumulative curves.
Prefix sums of those counts over the stretches place every rank, which gives exact quantiles and
distincts; the pieces of two loads' curves, shifted by their prefixes, give the exact Kolmogorov-Smirnov
distance, and the sum of their steps the distance of the shares.

Numbers are sorted by their exact value: 64-bit integers and times are never rounded to doubles. Strings and booleans need no order of their own; they are sorted by 128 bits of hash, so that
long texts travel once. The forms of strings are counted from the same counts.

Held whole anywhere is one row per (load, column) of counts and ranges, which ``max_cells`` bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.sources.shared import keep, small

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
STRETCH = 50_000  # sorted counts that are looked at together, about
RANGE_ROWS = 2_000_000  # counts in a range partition, about
#: Of a load: n, n_distinct, outside, values and counts (numbers only). Of a load and its baseline (pair): n, n_base, the
#: least and greatest difference of the curves within the stretch, and the summed difference of the shares.
PIECE = (
    "load_id long, column int, pid int, seq int, pair boolean, n long, n_base long, n_distinct long, outside long, "
    "low double, high double, moved double, nums array<double>, cnts array<long>"
)
PIECE_ARROW = pa.schema(
    [("load_id", pa.int64()), ("column", pa.int32()), ("pid", pa.int32()), ("seq", pa.int32()), ("pair", pa.bool_()), ("n", pa.int64()), ("n_base", pa.int64()),
     ("n_distinct", pa.int64()), ("outside", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("moved", pa.float64()),
     ("nums", pa.list_(pa.float64())), ("cnts", pa.list_(pa.int64()))]
)


def kind_of(dtype: T.DataType) -> str | None:
    """number, string, boolean or time; None for types that aren't profiled (nested, binary)."""
    if isinstance(dtype, NUMBERS):
        return "number"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "time" if isinstance(dtype, TIMES) else None


def _key(name: str, dtype: T.DataType) -> tuple[str, Column, float]:
    """(how the column is counted, its exact value, what to divide it by): double, long, text, or a decimal type of over 18 digits."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, TIMES):
        return "long", F.unix_micros(c.cast("timestamp")), 1e6
    if isinstance(dtype, T.FloatType | T.DoubleType):
        c = c.cast("double")
        return "double", F.when(~F.isnan(c), c + F.lit(0.0)), 1.0  # NaN counts as null; -0.0 is 0.0
    if isinstance(dtype, T.DecimalType):
        if dtype.precision > 18:
            return f"decimal({dtype.precision},{dtype.scale})", c, 1.0
        return "long", (c * F.lit(10**dtype.scale).cast("decimal(19,0)")).cast("long"), 10.0**dtype.scale
    if isinstance(dtype, NUMBERS):
        return "number"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "time" if isinstance(dtype, TIMES) else None


def _key(name: str, dtype: T.DataType) -> tuple[str, Column, float]:
    """(how the column is counted, its exact value, what to divide it by): double, long, text, or a decimal type of over 18 digits."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, TIMES):
        return "long", F.unix_micros(c.cast("timestamp")), 1e6
    if isinstance(dtype, T.FloatType | T.DoubleType):
        c = c.cast("double")
        return "double", F.when(~F.isnan(c), c + F.lit(0.0)), 1.0  # NaN counts as null; -0.0 is 0.0
    if isinstance(dtype, T.DecimalType):
        whole = c.cast("decimal(38,18)") if dtype.precision - dtype.scale > 20 else c
        unscaled = (whole * F.lit(10**dtype.scale).cast("decimal(38,0)")).cast("decimal(38,0)")
        return ("long", unscaled.cast("long"), 10.0**dtype.scale) if dtype.precision <= 18 else ("wide", F.expr(f"cast(replace(cast(`{name}` as string), '.', '') as decimal(38,0))"), 10.0**dtype.scale)
    if isinstance(dtype, NUMBERS):
        return "long", c.cast("long"), 1.0
    return "text", c.cast("string"), 1.0


def form_of(value):
    """The value with each run of A-Z, a-z made one ``a`` and then each run of 0-9 one ``9``."""
    return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "a"), "[0-9]+", "9")


def _counted(df: DataFrame, load: str, cells: dict[int, Column]) -> DataFrame:
    """(load_id, column, value, cnt) of all non-null cells, by an Expand in the scan's stage and a combine before the shuffle."""
    wide = df.select(F.col(f"`{load}`").cast("long").alias("load_id"), *[c.alias(str(i)) for i, c in cells.items()])
    long = wide.unpivot("load_id", [str(i) for i in cells], "column", "value").where(F.col("value").isNotNull())
    return long.groupBy("load_id", F.col("column").cast("int").alias("column"), "value").agg(F.count(F.lit(1)).alias("cnt"))


def _keys(counted: DataFrame, how: str, scale: dict[int, float]) -> DataFrame:
    """The counts with fixed-width sort keys: num, then big and low where doubles can't tell values apart."""
    v, zero = F.col("value"), F.lit(0).cast("long")
    if how == "text":
        num, big, low = F.lit(0.0), F.xxhash64(v), F.xxhash64(F.lit(7), v)
    else:
        by = F.lit(1.0)
        for i, x in scale.items():
            by = F.when(F.col("column") == i, F.lit(x)).otherwise(by) if x != 1.0 else by
        num = v.cast("double") / by
        if how.startswith("decimal"):  # told apart exactly, in the order of doubles
            big, low = F.xxhash64(v), F.xxhash64(F.lit(7), v)
        else:
            big, low = zero if how == "double" else v, zero
    return counted.select("load_id", "column", num.alias("num"), big.alias("big"), low.alias("low"), "cnt")


def _pieces(totals: dict, base_of: dict, numbers: set[int]):
    """A function that turns the sorted counts of range partitions into pieces, stretch by stretch."""

    def stretch(rows: list[np.ndarray], seq: int, pid: int) -> list[tuple]:
        loads, columns, nums, bigs, lows, cnts = rows
        out = []
        edges = [0, *(np.flatnonzero(columns[1:] != columns[:-1]) + 1).tolist(), len(columns)]
        for a, b in zip(edges, edges[1:]):
            column, num = int(columns[a]), nums[a:b]
            new = (num[1:] != num[:-1]) | (bigs[a + 1 : b] != bigs[a : b - 1]) | (lows[a + 1 : b] != lows[a : b - 1])
            at = np.concatenate([[0], np.cumsum(new)])  # values by number, in order
            order = np.argsort(loads[a:b], kind="stable")
            names, starts = np.unique(loads[a:b][order], return_index=True)
            of = {int(k): order[i:j] for k, i, j in zip(names, starts, [*starts[1:], len(order)])}
            none = np.empty(0, np.int64)
            for load, held in of.items():
                c = cnts[a:b][held]
                base = totals.get((base_of.get(load), column))
                v = num[held]
                outside = int(c[(v < base[1]) | (v > base[2])].sum()) if column in numbers and base else 0
                keep_values = column in numbers
                out.append((load, column, pid, seq, False, int(c.sum()), 0, len(held), outside, None, None, None, v if keep_values else None, c if keep_values else None))
            for load, base in base_of.items():
                mine, theirs = totals.get((load, column)), totals.get((base, column))
                if not mine or not theirs or (load not in of and base not in of):
                    continue
                l, r = of.get(load, none), of.get(base, none)
                u = np.unique(np.concatenate([at[l], at[r]]))
                x, y = np.zeros(len(u)), np.zeros(len(u))
                x[np.searchsorted(u, at[l])] = cnts[a:b][l]
                y[np.searchsorted(u, at[r])] = cnts[a:b][r]
                step_x, step_y = x / mine[0], y / theirs[0]
                d = np.cumsum(x) / mine[0] - np.cumsum(y) / theirs[0]
                out.append((load, column, pid, seq, True, int(x.sum()), int(y.sum()), 0, 0, min(0.0, d.min()), max(0.0, d.max()), float(np.abs(step_x - step_y).sum()), None, None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        held: list[list[np.ndarray]] = []
        size = 0

        def cut(final: bool):
            nonlocal held, size, seq
            rows = [np.concatenate(x) for x in zip(*held)]
            end = len(rows[0])
            if not final:  # rows of one value stay together
                same = np.ones(end - 1, bool)
                for x in rows[1:5]:
                    same &= x[1:] == x[:-1]
                breaks = np.flatnonzero(~same)
                if not len(breaks):
                    held = [rows]
                    return None
                end = int(breaks[-1]) + 1
            found = stretch([x[:end] for x in rows], seq, pid)
            seq += 1
            rest = [x[end:] for x in rows]
            held, size = ([rest] if len(rest[0]) else []), len(rest[0])
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), PIECE_ARROW.types)], schema=PIECE_ARROW)

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
                if size >= STRETCH and (made := cut(False)) is not None:
                    yield made
        if held:
            yield cut(True)

    return run


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _at_ranks(nums: pd.Series, cnts: pd.Series, ranks: pd.Series) -> pd.Series:
    """The values at the given 0-based ranks of a piece; null for ranks outside it."""
    out = []
    for v, c, want in zip(nums, cnts, ranks):
        ends = np.cumsum(c)
        out.append([float(v[np.searchsorted(ends, r, "right")]) if 0 <= r < ends[-1] else None for r in want])
    return pd.Series(out)


def _quantiles(pieces: DataFrame, points: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles by (load_id, column), array in the order of ``points``."""
    keys = ["load_id", "column", "pid", "seq"]
    w = Window.partitionBy("load_id", "column")
    loads = pieces.where("not pair and nums is not null")
    placed = loads.select(*keys, "n", F.sum("n").over(w).alias("total"), (F.sum("n").over(w.orderBy("pid", "seq")) - F.col("n")).alias("before"))
    ranks = []
    for p in points:
        at = F.lit(float(p)) * (F.col("total") - 1)
        ranks += [F.floor(at).cast("long"), F.ceil(at).cast("long")]
    placed = placed.withColumn("ranks", F.transform(F.array(*ranks), lambda r: r - F.col("before")))
    # At most two stretches a point, load and column: the bound of max_cells holds here too.
    holding = F.broadcast(placed.where(F.exists("ranks", lambda r: (r >= 0) & (r < F.col("n")))).select(*keys, "total", "ranks"))
    found = loads.select(*keys, "nums", "cnts").join(holding, keys).select("load_id", "column", "total", _at_ranks("nums", "cnts", "ranks").alias("at"))
    k = range(2 * len(points))
    flat = found.groupBy("load_id", "column").agg(F.max("total").alias("total"), *[F.max(F.col("at")[i]).alias(f"v{i}") for i in k])

    def between(i: int, p: float):
        lo, hi, at = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), F.lit(float(p)) * (F.col("total") - 1)
        if p == 0.5:
            return (lo + hi) / 2.0
        return lo + (hi - lo) * (at - F.floor(at))

    return flat.select("load_id", "column", F.array(*[between(i, p) for i, p in enumerate(points)]).alias("quantiles"))


def _distances(pieces: DataFrame) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance and half the sum of the shares' differences, by load and column."""
    w = Window.partitionBy("load_id", "column")
    up = w.orderBy("pid", "seq")
    pairs = pieces.where("pair")
    shift = (F.sum("n").over(up) - F.col("n")) / F.sum("n").over(w) - (F.sum("n_base").over(up) - F.col("n_base")) / F.sum("n_base").over(w)
    shifted = pairs.select("load_id", "column", "low", "high", "moved", shift.alias("shift"))
    return shifted.groupBy("load_id", "column").agg(
        F.max(F.greatest(F.abs(F.col("shift") + F.col("low")), F.abs(F.col("shift") + F.col("high")))).alias("ks"), (F.sum("moved") / 2.0).alias("moved")
    )


def _forms(values: DataFrame, base_of: DataFrame) -> DataFrame:
    """Per (load_id, column): usual form and its count, the baseline's usual form and its counts in both."""
    keys = ["load_id", "column"]
    forms = keep(values.groupBy(*keys, form_of(F.col("value")).alias("form")).agg(F.sum("cnt").alias("cnt")), "profile-forms")
    # The most frequent form, of equal ones the first: the greatest count first, then only the forms that have it.
    most = forms.groupBy(*keys).agg(F.max("cnt").alias("cnt"))
    top = keep(forms.join(F.broadcast(most), [*keys, "cnt"]).groupBy(*keys).agg(F.min("form").alias("form"), F.max("cnt").alias("top_cnt")), "profile-top")
    usual = base_of.join(top.select(F.col("load_id").alias("base_id"), "column", F.col("form").alias("base_form"), F.col("top_cnt").alias("base_form_cnt")), "base_id")
    held = F.broadcast(usual).join(forms.select(*keys, F.col("form").alias("base_form"), F.col("cnt").alias("held")), [*keys, "base_form"])
    own = top.select(*keys, "form", "top_cnt")
    theirs = usual.select(*keys, "base_form", "base_form_cnt")
    return _measures([own, theirs, held.select(*keys, F.col("held").alias("base_form_held"))], keys)


def _measures(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of one row per key side by side: one shuffle, where joins would take one each."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in every.columns if c not in keys]
    simple = {f.name for f in every.schema if not isinstance(f.dataType, T.ArrayType)}
    return every.groupBy(*keys).agg(*[(F.max(c) if c in simple else F.max(F.struct(F.col(c).isNotNull().alias("some"), F.col(c).alias("x")))["x"]).alias(c) for c in names])


def quality_profile(
    df: DataFrame,
    loads: DataFrame,
    *,
    load: str = "load_id",
    baseline: str = "baseline_load_id",
    skip: tuple[str, ...] = (),
    points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95),
    few_values: int = 20,
    max_cells: int = 500_000,
) -> DataFrame:
    """One row per (load_id, column_name) with counts, range, form, tags and drift measures.

    Null and NaN are null; empty and blank strings are values. Rows whose load is null belong to no
    load. Columns of nested or binary type are not profiled, nor those in ``skip``; further columns of
    any name are profiled like the rest. An empty table gives no row. Drift measures are null where
    the load has no baseline or one of both has no non-null value. Ties of the most frequent form go
    to the first in code point order. Integers, times and decimals of up to 18 digits are compared exactly;
    longer decimals are told apart exactly and ordered as doubles. Ranges and quantiles are given as doubles. ``max_cells`` bounds loads times columns; beyond it an error says so.
    """
    spark = df.sparkSession
    kinds = {f.name: k for f in df.schema if f.name not in {load, *skip} and (k := kind_of(f.dataType))}
    names, types = list(kinds), {f.name: f.dataType for f in df.schema}
    df = df.where(F.col(f"`{load}`").isNotNull())
    groups: dict[str, dict[int, Column]] = {}
    scale: dict[int, float] = {}
    for i, name in enumerate(names):
        how, value, scale[i] = _key(name, types[name])
        groups.setdefault(how, {})[i] = value
    numbers = {i for how, cells in groups.items() if how != "text" for i in cells}
    keys = ["load_id", "column"]

    counted = {how: keep(_counted(df, load, cells), f"profile-{how}") for how, cells in groups.items()}
    ranged = {how: _keys(c, how, scale) for how, c in counted.items()}
    sizes = df.groupBy(F.col(f"`{load}`").cast("long").alias("load_id")).agg(F.count(F.lit(1)).alias("rows"))
    each = sizes.select("load_id", "rows", F.explode(F.array(*[F.lit(i) for i in range(len(names))]) if names else F.array().cast("array<int>")).alias("column"))
    totals = [each]
    for how, rows in ranged.items():
        if how == "text":
            totals.append(counted[how].groupBy(*keys).agg(F.sum("cnt").alias("n"), F.min("value").alias("min_text"), F.max("value").alias("max_text")))
        else:
            totals.append(rows.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.min("num").alias("min_number"), F.max("num").alias("max_number")))
    basics = _measures(totals, keys)
    for name, dtype in (("n", "long"), ("min_number", "double"), ("max_number", "double"), ("min_text", "string"), ("max_text", "string")):
        if name not in basics.columns:
            basics = basics.withColumn(name, F.lit(None).cast(dtype))
    basics = keep(basics.withColumn("n", F.coalesce("n", F.lit(0))), "profile-basics")
    pairs = loads.select(F.col(load).cast("long").alias("load_id"), F.col(baseline).cast("long").alias("base_id")).where("load_id is not null")
    pairs = pairs.groupBy("load_id").agg(F.max("base_id").alias("base_id"))
    base_of = {r.load_id: r.base_id for r in small(pairs.where("base_id is not null"), max_cells, "loads")}
    held = small(basics.select(*keys, "n", "min_number", "max_number"), max_cells, "loads times columns")
    total_of = {(r.load_id, r.column): (r.n, r.min_number, r.max_number) for r in held if r.n}

    used = list(points) if 0.5 in points else [*points, 0.5]
    parts = [basics]
    if ranged:
        order = ["column", "num", "big", "low"]
        rows = reduce(DataFrame.unionByName, ranged.values()).select("load_id", *order, "cnt")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(c.count() for c in counted.values()) // RANGE_ROWS))
        # The range exchange samples its input; that reads the counts again, not the table.
        pieces = keep(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pieces(total_of, base_of, numbers), PIECE), "profile-pieces")
        parts.append(pieces.where("not pair").groupBy(*keys).agg(F.sum("n_distinct").alias("n_distinct"), F.sum("outside").alias("n_outside")))
        parts += [_quantiles(pieces, used), _distances(pieces)]
    if "text" in counted:
        parts.append(_forms(counted["text"], pairs.where("base_id is not null")))
    measured = _measures(parts, keys)
    for name, dtype in (
        ("n_distinct", "long"), ("n_outside", "long"), ("quantiles", "array<double>"), ("ks", "double"), ("moved", "double"), ("form", "string"), ("top_cnt", "long"),
        ("base_form", "string"), ("base_form_cnt", "long"), ("base_form_held", "long"),
    ):
        if name not in measured.columns:
            measured = measured.withColumn(name, F.lit(None).cast(dtype))
    label = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    kind = F.array(*[F.lit(kinds[n]) for n in names]) if names else F.array().cast("array<string>")
    number = F.get(kind, F.col("column")).isin("number", "time")
    one = measured.where("rows is not null").select(
        "load_id",
        F.get(label, F.col("column")).alias("column_name"),
        F.get(kind, F.col("column")).alias("kind"),
        "rows",
        "n",
        (1.0 - F.col("n") / F.col("rows")).alias("null_rate"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        (F.coalesce("n_distinct", F.lit(0)) / F.nullif(F.col("n"), F.lit(0))).alias("uniqueness_ratio"),
        "min_number", "max_number", "min_text", "max_text",
        "quantiles",
        F.col("quantiles")[used.index(0.5)].alias("median"),
        F.col("form").alias("usual_form"),
        (F.col("top_cnt") / F.col("n")).alias("usual_form_share"),
        (F.col("n") - F.col("top_cnt")).alias("n_off_form"),
        F.when(number, F.col("ks")).alias("ks"), F.when(number & F.col("ks").isNotNull(), F.col("n_outside")).alias("n_outside"),
        "base_form", "base_form_cnt", F.when(F.col("base_form").isNotNull(), F.coalesce("base_form_held", F.lit(0))).alias("base_form_held"),
        F.when(~number, F.col("moved")).alias("moved"),
    )
    one = keep(one, "profile")  # one row per load and column; the comparison below reads it twice
    base = one.select(
        F.col("load_id").alias("base_id"), "column_name",
        F.col("n").alias("b_n"), F.col("null_rate").alias("b_null_rate"), F.col("n_distinct").alias("b_n_distinct"),
        F.col("uniqueness_ratio").alias("b_uniqueness_ratio"), F.col("median").alias("b_median"),
    )
    few = (F.col("n_distinct") <= few_values) & (F.col("b_n_distinct") <= few_values)
    return (
        one.join(F.broadcast(pairs), "load_id", "left")
        .join(F.broadcast(base), ["base_id", "column_name"], "left")
        .select(
            *one.columns[:17],
            F.col("base_id").alias("baseline_load_id"),
            (F.col("null_rate") - F.col("b_null_rate")).alias("null_rate_change"),
            (F.col("median") - F.col("b_median")).alias("median_change"),
            "b_median",
            (F.col("n_outside") / F.nullif(F.col("n"), F.lit(0))).alias("outside_share"),
            (F.col("uniqueness_ratio") - F.col("b_uniqueness_ratio")).alias("uniqueness_change"),
            F.when(F.col("n") > 0, F.col("base_form_held") / F.col("n") - F.col("base_form_cnt") / F.col("b_n")).alias("form_share_change"),
            F.when(F.col("n") > 0, F.col("n") - F.col("base_form_held")).alias("n_off_baseline_form"),
            F.when(few, F.col("moved")).alias("share_distance"),
            "ks",
        )
    )


def drift_reasons(profile: DataFrame, *, null_rate=0.15, median=0.25, outside=0.10, uniqueness=0.25, form=0.3, shares=0.3) -> DataFrame:
    """The profile with ``reasons``: which drift rules a column breaks against its baseline (empty: none)."""
    number, string = F.col("kind") == "number", F.col("kind") == "string"
    rules = {
        "null_rate": F.abs("null_rate_change") > null_rate,
        "median": number & (F.abs("median_change") > median * F.abs("b_median")),
        "outside_range": number & (F.col("outside_share") > outside),
        "uniqueness": string & (F.abs("uniqueness_change") > uniqueness),
        "form": string & (F.col("form_share_change") < -form),
        "shares": F.col("kind").isin("string", "boolean") & (F.col("share_distance") > shares),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return profile.withColumn("reasons", found)


def quality_tags(profile: DataFrame) -> DataFrame:
    """The profile with ``quality_tags``, an array of short labels for columns that need a look."""
    u, n, d = F.col("uniqueness_ratio"), F.col("n"), F.col("n_distinct")
    tags = {
        "all_null": n == 0,
        "high_null_rate": (F.col("null_rate") > 0.5) & (n > 0),
        "constant": d == 1,
        "id_like": (u >= 0.99) & (d > 1),
        "mixed_forms": (F.col("kind") == "string") & (F.col("usual_form_share") < 0.5),
        "negative_values": F.col("min_number") < 0,
    }
    return profile.withColumn("quality_tags", F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in tags.items()])))
