"""Catalogue exploration: filtered and sorted heads, value listings, details, comparison, summaries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.model import ConstraintSpec
from lodestock.operators.predicates import NUMERIC, constraint_filter, number
from lodestock.operators.quantiles import quantile_row


def visible(df: DataFrame) -> DataFrame:
    """Without private columns (names that begin with ``_``)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def project(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order, each once."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(wanted) if c in df.columns])


def filter_sort_limit(
    df: DataFrame,
    constraints: dict[str, Any],
    registry: list[ConstraintSpec],
    id_column: str,
    sort_by: str | None = None,
    descending: bool = False,
    limit: int = 30,
    cap: int = 200,
) -> DataFrame:
    """Rows that satisfy the constraints, sorted (numbers in text by value, nulls last both ways, ties by id)."""
    out = constraint_filter(df, constraints, registry)
    keys: list[Column] = []
    if sort_by and sort_by in df.columns:
        c = F.col(f"`{sort_by}`")
        keys = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
        if isinstance(df.schema[sort_by].dataType, T.StringType):
            n = number(c, T.StringType())
            keys = [n.desc_nulls_last() if descending else n.asc_nulls_last(), *keys]
    return visible(out.orderBy(*keys, id_column).limit(max(1, min(limit, cap))))


def list_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n) of a column by count, then value; elements of a list column count each."""
    c = F.col(f"`{column}`")
    values = F.explode(c.cast("array<string>")) if isinstance(df.schema[column].dataType, T.ArrayType) else c.cast("string")
    counts = df.select(values.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    out = counts.orderBy(F.col("n").desc(), "value")
    return out.limit(limit) if limit else out


def list_values_matching(df: DataFrame, column: str, query: str, order: str) -> DataFrame:
    """(value, n) of values that hold the query or lie in it, whatever the case; the spelling first by ``order`` stands for all."""
    c = F.col(f"`{column}`")
    values = F.explode(c.cast("array<string>")) if isinstance(df.schema[column].dataType, T.ArrayType) else c.cast("string")
    rows = df.select(values.alias("label"), F.col(order).alias("_o")).where("label is not null").withColumn("key", F.lower(F.trim("label")))
    q = query.strip().lower()
    hits = rows.where(F.contains(F.col("key"), F.lit(q)) | F.contains(F.lit(q), F.col("key")))
    return hits.groupBy("key").agg(F.min_by("label", F.struct("_o", "label")).alias("value"), F.count(F.lit(1)).alias("n")).select("value", "n").orderBy(F.col("n").desc(), "value")


def list_values_similar(df: DataFrame, column: str, query: str, least: float = 0.5) -> DataFrame:
    """(value, n, ratio) of values alike the query by matching blocks, for when none holds it; compares distinct values only."""
    from lodestock.operators.resolve import similarity

    values = list_values(df, column).withColumn("ratio", similarity(F.col("value"), query.strip()))
    return values.where(F.col("ratio") >= least).orderBy(F.col("ratio").desc(), F.col("n").desc(), "value")


def describe_number(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of a number column."""
    x = number(F.col(f"`{column}`"), df.schema[column].dataType)
    q = quantile_row(df, {"x": x}, {"x": [("p25", 0.25), ("p50", 0.5), ("p75", 0.75)]})
    rest = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return rest.crossJoin(F.broadcast(q)).select("n", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row each


def details(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, label, value) of the given rows, one row per column in the given order, nulls left out."""
    known = [c for c in columns if c in df.columns]
    shown = []
    for i, c in enumerate(known):
        col = F.col(f"`{c}`")
        text = F.array_join(col.cast("array<string>"), ", ") if isinstance(df.schema[c].dataType, T.ArrayType) else col.cast("string")
        shown.append(F.struct(F.lit(i).alias("place"), F.lit(c).alias("label"), text.alias("value")))
    return df.select(F.col(id_column), F.inline(F.array(*shown))).where("value is not null")


def highlights(df: DataFrame, id_column: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: for each rule name -> (column, 'min' or 'max') the id with that extreme, ties by least id, nulls ignored."""
    aggs = []
    for name, (column, end) in rules.items():
        c = F.col(f"`{column}`")
        key = F.when(c.isNotNull(), F.struct(c if end == "min" else -c, F.col(id_column)))
        aggs.append(F.min(key)[id_column].alias(name))
    return df.agg(*aggs)


def summary(df: DataFrame, numbers: list[str], categories: list[str], top: int = 8) -> DataFrame:
    """(part, label, value): min, max and mean of numbers and the ``top`` values of categories with their counts."""
    flat = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}:{n}") for c in numbers for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    pairs = F.array(*[F.struct(F.lit(n.split(":")[0]).alias("part"), F.lit(n.split(":")[1]).alias("label"), F.col(f"`{n}`").alias("value")) for n in flat.columns])
    out = flat.select(F.inline(pairs))
    for c in categories:
        out = out.unionByName(list_values(df, c, top).select(F.lit(c).alias("part"), F.col("value").alias("label"), F.col("n").cast("double").alias("value")))
    return out


def catalog_stats(df: DataFrame, price: str, distinct: list[str]) -> DataFrame:
    """One row: count, min, max and median of the price, distinct counts, null counts."""
    p = number(F.col(price), df.schema[price].dataType)
    rest = df.agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct])
    return rest.crossJoin(F.broadcast(quantile_row(df, {"p": p}, {"p": [("median_price", 0.5)]})))  # one row each


def schema_hints(df: DataFrame) -> list[tuple[str, str]]:
    """(column, kind) for tools: number, flag, list, date or text."""
    kinds = ((T.BooleanType, "flag"), (NUMERIC, "number"), (T.ArrayType, "list"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date"))
    return [(f.name, next((k for t, k in kinds if isinstance(f.dataType, t)), "text")) for f in df.schema]
