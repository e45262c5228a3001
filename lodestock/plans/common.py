"""Registration of queries, and the catalogue that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with their sales: the catalogue of the scoring and evaluation queries."""
    sold = table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_sold"), F.sum("l_quantity").alias("qty_sold"), F.avg("l_discount").alias("avg_disc")
    )
    part = table(spark, folder, "part")
    return part.join(sold, part["p_partkey"] == sold["l_partkey"], "left").drop("l_partkey").withColumn("tags", F.split("p_name", " "))


CAT = """cat as (select p.*, n_sold, qty_sold, avg_disc, string_split(p_name, ' ') tags from part p left join
  (select l_partkey, count(*) n_sold, sum(l_quantity) qty_sold, avg(l_discount) avg_disc from lineitem group by 1) on l_partkey = p_partkey)"""

#: 25 tasks made from the nations: bounds, tier and recommended parts follow from the key.
TASKS = """tasks25 as (select n_nationkey task_id, 910.0::double + 3 * n_nationkey price_max, 10 + n_nationkey size_max,
  case n_nationkey % 5 when 0 then 'small' when 1 then 'medium' when 2 then 'large' when 3 then 'oc_feasible' else 'oc_infeasible' end difficulty from nation)"""
#: Every part is a recommendation of its task.
RECS = """recs as (select p_partkey % 25 task_id, row_number() over (partition by p_partkey % 25 order by p_partkey) pos, p_partkey pid from part)"""
#: Pools with utility: the lower price counts 2/3, the higher sales 1/3, scaled over the pool.
POOLS = """pool0 as (select task_id, difficulty, p_partkey pid, p_retailprice price, coalesce(n_sold, null)::double sold from cat join tasks25 on p_retailprice <= price_max and p_size <= size_max),
pool1 as (select *, min(price) over w plo, max(price) over w phi, min(sold) over w slo, max(sold) over w shi from pool0 window w as (partition by task_id)),
pools as (select task_id, difficulty, pid, (2.0::double / 3) * (case when phi = plo then 1 else (phi - price) / (phi - plo) end)
  + (1.0::double / 3) * (case when sold is null then 0 when shi = slo then 1 else (sold - slo) / (shi - slo) end) utility from pool1)"""


def tasks25(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("n_nationkey")
    tier = F.element_at(F.array(*[F.lit(x) for x in ("small", "medium", "large", "oc_feasible", "oc_infeasible")]), (k % 5 + 1).cast("int"))
    return table(spark, folder, "nation").select(k.alias("task_id"), (F.lit(910.0) + k * 3).alias("price_max"), (k + 10).alias("size_max"), tier.alias("difficulty"))


def recs(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a recommendation of its task."""
    from pyspark.sql import Window

    p = table(spark, folder, "part").select((F.col("p_partkey") % 25).alias("task_id"), F.col("p_partkey").alias("pid"))
    return p.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy("pid")))
