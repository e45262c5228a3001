"""Soft preferences: weights by priority, pool statistics, utility on [0, 1], ranking and reward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.model import Preference
from lodestock.operators.predicates import TEMPORAL, missing, number
from lodestock.sources.shared import keep


def weights(n: int) -> list[float]:
    """Weights that halve from one priority to the next and sum to 1."""
    return [2.0 ** (n - 1 - i) / (2.0**n - 1.0) for i in range(n)]


def ordered(preferences: list[Preference]) -> list[Preference]:
    return sorted(preferences, key=lambda p: p.priority)


def as_number(c: Column, dtype: T.DataType) -> Column:
    """A value for scoring: numbers, else dates as epoch seconds, of a list its first element; else null."""
    if isinstance(dtype, T.ArrayType):
        return as_number(F.try_element_at(c, F.lit(1)), dtype.elementType)
    if isinstance(dtype, TEMPORAL):
        return (F.unix_micros(c.cast("timestamp")) / 1e6).cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.StringType):
        return F.coalesce(c.try_cast("double"), F.unix_micros(c.try_cast("timestamp")) / 1e6)
    return number(c, dtype)


def pool_stats(pool: DataFrame, preferences: list[Preference], by: list[str] | None = None) -> DataFrame:
    """min and max of every preference attribute over the pool, columns ``<attribute>_min`` and ``_max``.

    ``match`` preferences have 0 and 1; an empty pool has 0 and 0. With ``by``, one row per group.
    """
    aggs = []
    for p in ordered(preferences):
        if p.direction == "match":
            low, high = F.lit(0.0), F.lit(1.0)
        else:
            x = as_number(F.col(f"`{p.attribute}`"), pool.schema[p.attribute].dataType)
            low, high = F.coalesce(F.min(x), F.lit(0.0)), F.coalesce(F.max(x), F.lit(0.0))
        aggs += [low.alias(f"{p.attribute}_min"), high.alias(f"{p.attribute}_max")]
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("n")]
    return pool.groupBy(*(by or [])).agg(*aggs)


def utility(df: DataFrame, preferences: list[Preference], stats_prefix: str = "", weight: list[float] | None = None) -> Column:
    """Weighted sum of the preferences' scores; needs the columns of ``pool_stats`` in ``df``.

    1.0 without preferences; 0.0 if there are not as many weights as preferences. A missing value scores 0,
    an attribute whose pool has one value 1.
    """
    prefs = ordered(preferences)
    if not prefs:
        return F.lit(1.0)
    w = weights(len(prefs)) if weight is None else weight
    if len(w) != len(prefs):
        return F.lit(0.0)
    total = F.lit(0.0)
    for p, wi in zip(prefs, w):
        c, dtype = F.col(f"`{p.attribute}`"), df.schema[p.attribute].dataType
        if p.direction == "match":
            want = str(p.target or "").lower()
            if isinstance(dtype, T.ArrayType):
                hit = F.exists(c, lambda x: F.lower(x.cast("string")) == want)
            else:
                hit = F.lower(c.cast("string")) == want
            score = F.when(F.coalesce(hit, F.lit(False)) & ~missing(c, dtype), 1.0).otherwise(0.0)
        else:
            x, lo, hi = as_number(c, dtype), F.col(f"`{stats_prefix}{p.attribute}_min`"), F.col(f"`{stats_prefix}{p.attribute}_max`")
            part = (hi - x if p.direction == "minimize" else x - lo) / (hi - lo)
            score = F.when(x.isNull(), 0.0).when(hi == lo, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))
        total = total + F.lit(float(wi)) * score
    return total


def score_pool(pool: DataFrame, preferences: list[Preference], by: list[str] | None = None) -> DataFrame:
    """The pool with ``utility``. The statistics are one row (or one per group), joined by broadcast or hash."""
    stats = pool_stats(pool, preferences, by)
    joined = pool.join(stats, by) if by else pool.crossJoin(F.broadcast(stats))  # an aggregate without keys is one row
    return joined.withColumn("utility", utility(joined, preferences)).select(*pool.columns, "utility")


def ranked(scored: DataFrame, id_column: str, by: list[str] | None = None) -> DataFrame:
    """With ``position`` (ties by id) and ``best`` (ties with the highest utility).

    Without ``by`` the whole pool is one order: it is range-sorted, and positions are those within a range plus the
    sizes of the ranges before it, so no task sees all of it.
    """
    order = [F.col("utility").desc(), F.col(id_column)]
    if by:
        top = F.max("utility").over(Window.partitionBy(*by))
        return scored.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("best", F.col("utility") == top)
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(scored.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.max("utility").alias("_top"))
    w = Window.orderBy("_range")  # one row a range
    before = sizes.select("_range", (F.sum("_n").over(w) - F.col("_n")).cast("int").alias("_before"), F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_top"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumns({"position": F.col("_before") + inside, "best": F.col("utility") == F.col("_top")}).drop("_range", "_before", "_top")


def best_set(scored: DataFrame, id_column: str) -> DataFrame:
    """All rows that tie with the highest utility, without sorting the pool."""
    top = scored.agg(F.max("utility").alias("top"))
    return scored.crossJoin(F.broadcast(top)).where("utility = top").drop("top")


def reward(best: Column, low: Column, high: Column, any_satisfying: Column) -> Column:
    """0 if nothing recommended satisfies; else 0.5 plus half of the best one's place between pool minimum and maximum."""
    return (
        F.when(~any_satisfying | best.isNull(), 0.0).when(high == low, 1.0).otherwise(F.lit(0.5) + F.lit(0.5) * (best - low) / (high - low))
    )


def boosted(score: Column, popularity: Column, low: Column, high: Column, factor: float = 0.2) -> Column:
    """A relevance score raised by up to ``factor`` with popularity, min-max scaled (range at least 1)."""
    place = (popularity - low) / F.greatest(high - low, F.lit(1.0))
    return score * (F.lit(1.0) + F.lit(factor) * F.coalesce(place, F.lit(0.0)))


def anchor_weight(df: DataFrame, optional: list[str], popularity: str | None = None) -> Column:
    """2 for each optional attribute present plus ln(1 + popularity), at least 0.1, not yet normalised."""
    held = F.lit(1.0)
    if optional:
        held = sum((F.col(f"`{c}`").isNotNull().cast("double") for c in optional), F.lit(0.0))
    pop = F.log1p(F.coalesce(F.col(f"`{popularity}`").cast("double"), F.lit(1.0))) if popularity else F.lit(1.0)
    return F.greatest(F.lit(2.0) * held + pop, F.lit(0.1))


def weighted_pick(df: DataFrame, weight: str, id_column: str, seed: int = 0, k: int = 1) -> DataFrame:
    """k rows drawn without replacement with probability by weight; the same seed draws the same rows."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))
    return df.orderBy(-F.log(u) / F.col(weight), id_column).limit(k)
