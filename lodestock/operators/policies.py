"""Baseline policies that recommend for all tasks at once, and set-oriented pools.

Tasks carry their constraints as rows (task_id, attribute, op, num, text), so that one pass over the
catalogue serves a block of tasks, as many as are broadcast at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestock.operators.search import hash_blocks


def task_pools(catalog: DataFrame, tasks: DataFrame, id_column: str, upper: dict[str, str], lower: dict[str, str] | None = None, max_tasks: int = 20_000, task: str = "task_id") -> DataFrame:
    """(task_id, catalogue columns) of all products that satisfy each task's bounds.

    ``upper`` maps a catalogue column to the task's column with its upper bound, ``lower`` likewise; a null
    bound constrains nothing, a null value fails a bound. Tasks go in blocks by hash of about ``max_tasks``.
    Columns that both sides have are an error: the result could not tell them apart.
    """
    if clash := sorted(set(catalog.columns) & set(tasks.columns)):
        raise ValueError(f"catalogue and tasks both have {', '.join(clash)}")
    cond = F.lit(True)
    for columns, below in ((upper, True), (lower or {}, False)):
        for c, b in columns.items():
            x, y = catalog[c], tasks[b]
            cond = cond & (y.isNull() | (x <= y if below else x >= y))
    keys = [task] if task in tasks.columns else list({*upper.values(), *(lower or {}).values()})
    return reduce(DataFrame.unionByName, [catalog.join(F.broadcast(block), cond) for block in hash_blocks(tasks, max_tasks, *keys)])


def random_k(hits: DataFrame, k: int, seed: int = 0, task: str = "task_id", product: str = "pid") -> DataFrame:
    """k products per task in an order by hash: the same seed gives the same products."""
    w = Window.partitionBy(task).orderBy(F.xxhash64(F.lit(seed), task, product), product)
    return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(task, "pos", product)


def top_k(hits: DataFrame, k: int, task: str = "task_id", product: str = "pid") -> DataFrame:
    """The k best-scored products per task."""
    w = Window.partitionBy(task).orderBy(F.col("score").desc(), product)
    return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(task, "pos", product)


def oracle(hits: DataFrame, pools: DataFrame, k: int, task: str = "task_id", product: str = "pid") -> DataFrame:
    """k satisfying products per task: those found by search first, by score, then the rest by id. Tasks without a pool give no row."""
    found = pools.select(task, product).join(hits.select(task, product, "score"), [task, product], "left")
    w = Window.partitionBy(task).orderBy(F.col("score").desc_nulls_last(), product)
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(task, "pos", product)


def infeasible_tasks(tasks: DataFrame, pools: DataFrame, task: str = "task_id") -> DataFrame:
    """Tasks that no product satisfies."""
    return tasks.join(pools.select(task).distinct(), task, "left_anti").select(task)


def stratified(tasks: DataFrame, per_tier: int, key, tier: str = "difficulty", task: str = "task_id") -> DataFrame:
    """Up to ``per_tier`` tasks of each tier, by an order column such as a seeded hash."""
    w = Window.partitionBy(tier).orderBy(key, task)
    return tasks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_tier).drop("_r")


def proportional(counts: dict[str, int], total: int) -> dict[str, int]:
    """Shares of a total in proportion to counts, whole numbers that sum to it; the largest parts take the rounding."""
    whole = sum(counts.values()) or 1
    out = {k: round(total * v / whole) for k, v in counts.items()}
    order = sorted(counts, key=lambda k: (-counts[k], k))
    i = 0
    while (gap := total - sum(out.values())) and order:
        k = order[i % len(order)]
        step = 1 if gap > 0 else -1
        if out[k] + step >= 0:
            out[k] += step
        i += 1
    return out
