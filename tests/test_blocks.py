"""More tasks or queries than are broadcast at once go in blocks, with the same result."""

from pyspark.sql import functions as F

from lodestock.operators import policies, search
from lodestock.sources.tables import table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pools_in_blocks(spark):
    catalog = spark.range(60).select(F.col("id").alias("pid"), (F.col("id") % 20).alias("price"))
    tasks = spark.range(25).select(F.col("id").alias("task_id"), F.when(F.col("id") > 0, F.col("id") % 10).alias("price_max"))
    whole = rows(policies.task_pools(catalog, tasks, "pid", {"price": "price_max"}).select("task_id", "pid"))
    split = rows(policies.task_pools(catalog, tasks, "pid", {"price": "price_max"}, max_tasks=4).select("task_id", "pid"))
    assert whole == split and len(whole) == 60 + sum(3 * (t % 10 + 1) for t in range(1, 25))


def test_semantic_pairs_in_blocks(spark, small):
    df = table(spark, small, "embeddings").limit(40).localCheckpoint()
    whole = rows(search.semantic_pairs(df, df, 3, "vec_id", "vec_id"))
    assert whole and rows(search.semantic_pairs(df, df, 3, "vec_id", "vec_id", max_queries=15)) == whole
