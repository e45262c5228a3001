"""Joins by order: the last row before, rows within intervals, and both sides whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], *, block: str = "1 day", strict: bool = False) -> DataFrame:
    """``left`` with ``values`` of the last right row of the same key at or before its time (before it, if ``strict``); null if there is none.

    Both sides are put in one order by blocks of time: inside a block a window carries the last row on, and what
    earlier blocks leave is one row a key and block. So a key with a third of all rows is spread over its blocks.
    Of right rows with the same key and time the greatest values count. Null keys and times match nothing.
    """
    size = F.expr(f"interval {block}")
    seconds = F.unix_seconds(F.timestamp_seconds(F.lit(0)) + size)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = F.struct(*[F.col(f"`{v}`").alias(v) for v in values])
    r = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(F.col(by).alias("_k"), micros(right_time).alias("_t"), held.alias("_v"))
    r = r.groupBy("_k", "_t").agg(F.max("_v").alias("_v")).withColumn("_side", F.lit(1 if strict else 0))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns])
    rows = left.select(F.col(by).alias("_k"), micros(left_time).alias("_t"), row.alias("_row")).withColumn("_side", F.lit(0 if strict else 1))
    both = r.unionByName(rows, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / (seconds * 1_000_000)))
    own = Window.partitionBy("_k", "_b").orderBy("_t", "_side")
    inside = both.withColumn("_in", F.last("_v", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # The last row of each block with any, and of all blocks before each block.
    ends = both.groupBy("_k", "_b").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_e"))
    carried = ends.select("_k", "_b", F.last("_e", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))["_v"].alias("_before"))
    out = inside.where("_row is not null").join(carried, ["_k", "_b"], "left")
    value = F.coalesce("_in", "_before")
    lost = rows.where("_k is null or _t is null").select("_row.*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return out.where("_k is not null and _t is not null").select("_row.*", *[value[v].alias(v) for v in values]).unionByName(lost)


def interval_join(points: DataFrame, spans: DataFrame, by: str, at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Points and spans of the same key with start <= at < end; ``width`` (in the unit of the columns) cuts the line into buckets.

    Spans are copied to the buckets they touch, so the join is by equality and no task sees more than a
    bucket of a key. Choose a width near the usual length of a span. Clashing names are the caller's to rename.
    """
    p = points.withColumns({"_at": at.cast("double"), "_bucket": F.floor(at.cast("double") / width)})
    s = spans.withColumns({"_start": start.cast("double"), "_end": end.cast("double")}).where("_end > _start")
    last = F.ceil(F.col("_end") / width) - 1
    s = s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_start") / width), F.greatest(F.floor(F.col("_start") / width), last))))
    return p.join(s, [by, "_bucket"]).where("_at >= _start and _at < _end").drop("_bucket", "_at", "_start", "_end")


def both_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with the key of either side; null keys of either side stand alone."""
    r = right.withColumnRenamed(key, "_key")
    return left.join(r, left[key] == r["_key"], "full_outer").withColumn(key, F.coalesce(key, "_key")).drop("_key")
