"""Exact quantiles of columns of any size, by a range sort with prefix counts.

A percentile aggregate keeps a map of all distinct values in one task. Here equal values are counted
first, the counts are range-sorted by (column, value), prefix sums over the ranges tell which range holds a
rank, and only those ranges are walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestock.sources.shared import keep

RANGE_ROWS = 2_000_000  # distinct values in a range, about


def exact_quantiles(df: DataFrame, columns: dict[str, Column], points: list[float]) -> DataFrame:
    """(column_name, n, q): the number of non-null values and their linearly interpolated quantiles, in the order of ``points``.

    Columns are cast to double. A column without values gives no row. NaN must have been made null.
    """
    names = list(columns)
    wide = df.select(*[c.cast("double").alias(str(i)) for i, c in enumerate(columns.values())])
    long = wide.unpivot([], [str(i) for i in range(len(names))], "k", "v").where("v is not null")
    counted = keep(long.groupBy(F.col("k").cast("int").alias("k"), "v").agg(F.count(F.lit(1)).alias("cnt")), "quantile-counts")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // RANGE_ROWS))
    ranged = keep(counted.repartitionByRange(parts, "k", "v").withColumn("pid", F.spark_partition_id()), "quantile-ranges")
    sums = ranged.groupBy("k", "pid").agg(F.sum("cnt").alias("n"))
    w = Window.partitionBy("k")
    placed = sums.withColumns({"total": F.sum("n").over(w), "before": F.sum("n").over(w.orderBy("pid")) - F.col("n")})
    at = [F.lit(float(p)) * (F.col("total") - 1) for p in points]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), f(x).cast("long").alias("rank")) for i, (f, x) in enumerate([(f, x) for x in at for f in (F.floor, F.ceil)])])
    # At most two rows a point and column.
    ranks = placed.select("k", "pid", "total", "before", "n", F.inline(wanted)).where("rank >= before and rank < before + n").select("k", "pid", "total", "i", (F.col("rank") - F.col("before")).alias("r"))
    ranks = F.broadcast(ranks)
    walked = ranged.join(F.broadcast(ranks.select("k", "pid").distinct()), ["k", "pid"]).withColumn("upto", F.sum("cnt").over(Window.partitionBy("k", "pid").orderBy("v")))
    found = walked.join(ranks, ["k", "pid"]).where("r < upto and r >= upto - cnt").groupBy("k").agg(F.max("total").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(2 * len(points))])

    def between(i: int, p: float) -> Column:
        x = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (x - F.floor(x)))

    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("k"))
    return found.select(label.alias("column_name"), "n", F.array(*[between(i, p) for i, p in enumerate(points)]).alias("q"))


def quantile_row(df: DataFrame, columns: dict[str, Column], points: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """One row with a column for each (name, point) of each of ``columns``, null where it has no values."""
    every = sorted({p for ps in points.values() for _, p in ps})
    q = exact_quantiles(df, columns, every)
    picks = [F.max(F.when(F.col("column_name") == c, F.col("q")[every.index(p)])).alias(name) for c, ps in points.items() for name, p in ps]
    return q.agg(*picks)
