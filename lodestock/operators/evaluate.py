"""Evaluation of recommendations, for all tasks in one job, and roll-ups of results.

Inputs are relations: recommendations (task, position, product), pools (task, product, utility) and
violations by (task, product). Keys are the caller's column names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestock.operators.scoring import reward

PARTS = 64
RANKING = ("ndcg_1", "ndcg_3", "ndcg_5", "ndcg_n", "graded_precision", "graded_recall", "graded_f1")


def dedup_recommendations(recs: DataFrame, task: str = "task_id", position: str = "pos", product: str = "pid") -> DataFrame:
    """Each product once per task, at its first position; positions are counted anew from 1."""
    first = recs.groupBy(task, product).agg(F.min(position).alias(position))
    return first.withColumn(position, F.row_number().over(Window.partitionBy(task).orderBy(position, product)))


def satisfaction(recs: DataFrame, violating: DataFrame, catalog: DataFrame, task: str = "task_id", product: str = "pid", id_column: str = "pid") -> DataFrame:
    """Per task: n recommended, n violating (not in the catalogue, or with a violation) and csr = 1 - violating / max(n, 1).

    ``violating`` is (task, product). A task without recommendations has csr 1.
    """
    unknown = recs.join(catalog.select(F.col(id_column).alias(product)), product, "left_anti").select(task, product)
    bad = unknown.unionByName(violating.select(task, product)).distinct().withColumn("bad", F.lit(1))
    per = recs.select(task, product).distinct().join(bad, [task, product], "left")
    return per.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_violating")).withColumn(
        "csr", F.lit(1.0) - F.col("n_violating") / F.greatest(F.col("n"), F.lit(1))
    )


def _gain(rel: Column, place: Column, k: Column | int) -> Column:
    return F.sum(F.when(place <= k, rel / F.log2(place + 1.0)).otherwise(0.0))


def ranking_metrics(recs: DataFrame, pools: DataFrame, task: str = "task_id", position: str = "pos", product: str = "pid") -> DataFrame:
    """ndcg_1, _3, _5, _n, graded precision, recall and F1 per task with recommendations; a product out of the pool has gain 0."""
    recs = dedup_recommendations(recs, task, position, product)
    got = recs.join(pools.select(task, product, "utility"), [task, product], "left").withColumn("rel", F.coalesce("utility", F.lit(0.0)))
    mine = got.groupBy(task).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rel").alias("captured"), *[_gain(F.col("rel"), F.col(position), k).alias(f"dcg_{k}") for k in (1, 3, 5)],
        F.sum(F.col("rel") / F.log2(F.col(position) + 1.0)).alias("dcg_n"),
    )
    # The ideal order needs the top n of each pool only. Pools are ranked in parts first, so that one task's pool,
    # however large, is not sorted by one Spark task; what is left per pool is a few times n.
    most = mine.select(task, F.greatest(F.col("n"), F.lit(5)).alias("n"))
    order = [F.col("utility").desc(), F.col(product)]
    parts = pools.select(task, product, "utility").join(most, task).withColumn("part", F.pmod(F.xxhash64(product), F.lit(PARTS)))
    first = parts.withColumn("place", F.row_number().over(Window.partitionBy(task, "part").orderBy(*order))).where("place <= n")
    tops = first.withColumn("place", F.row_number().over(Window.partitionBy(task).orderBy(*order)))
    n = mine.select(task, F.col("n").alias("n_"))
    ideal = tops.join(n, task).groupBy(task).agg(
        *[_gain(F.col("utility"), F.col("place"), k).alias(f"idcg_{k}") for k in (1, 3, 5)], _gain(F.col("utility"), F.col("place"), F.col("n_")).alias("idcg_n")
    )
    ideal = ideal.join(pools.groupBy(task).agg(F.sum("utility").alias("total"), F.max("utility").alias("max_rel")), task)
    joined = mine.join(ideal, task, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p = zero(F.when(F.col("max_rel") > 0, F.col("captured") / (F.col("n") * F.col("max_rel"))))
    r = zero(F.when(F.col("total") > 0, F.col("captured") / F.col("total")))
    return joined.select(
        task,
        F.col("n").alias("num_recommendations"),
        *[zero(F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}"))).alias(f"ndcg_{k}") for k in (1, 3, 5, "n")],
        p.alias("graded_precision"),
        r.alias("graded_recall"),
        F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(0.0).alias("graded_f1"),
    )


def rewards(recs: DataFrame, pools: DataFrame, task: str = "task_id", product: str = "pid") -> DataFrame:
    """Per task with a pool or recommendations: best recommended utility and reward; 0 if nothing recommended is in the pool."""
    range_ = pools.groupBy(task).agg(F.min("utility").alias("low"), F.max("utility").alias("high"))
    best = recs.select(task, product).distinct().join(pools.select(task, product, "utility"), [task, product]).groupBy(task).agg(F.max("utility").alias("best"))
    return range_.join(best, task, "left").select(
        task, "best", reward(F.col("best"), F.col("low"), F.col("high"), F.col("best").isNotNull()).alias("reward")
    )


def infeasible_reward(infeasible: Column, declared: Column) -> Column:
    """1 for declaring an infeasible task infeasible, else 0; null where nothing was declared."""
    return F.when(declared, F.when(F.coalesce(infeasible, F.lit(False)), 1.0).otherwise(0.0))


def evaluate(recs: DataFrame, pools: DataFrame, violating: DataFrame, catalog: DataFrame, id_column: str = "pid") -> DataFrame:
    """One row per task: reward, csr and ranking metrics."""
    return rewards(recs, pools).join(satisfaction(recs, violating, catalog, id_column=id_column), "task_id", "full").join(
        ranking_metrics(recs, pools), "task_id", "left"
    )


def by_difficulty(results: DataFrame, zero_if_absent: list[str], skip_if_absent: list[str], tier: str = "difficulty") -> DataFrame:
    """Means over all tasks (tier null) and by tier; absent values are 0 in the first list and left out in the second."""
    aggs = [F.count(F.lit(1)).alias("n_tasks")]
    aggs += [F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in zero_if_absent]
    aggs += [F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in skip_if_absent]
    return results.rollup(tier).agg(*aggs)


def by_task_over_trials(results: DataFrame, numbers: list[str], others: list[str] = (), task: str = "task_id", trial: str = "trial") -> DataFrame:
    """Mean and sample deviation (null of one trial) of each number, the first trial's other values, and the trial of highest reward."""
    aggs = [F.count(F.lit(1)).alias("n_trials")]
    for c in numbers:
        x = F.col(c).cast("int").cast("double") if dict(results.dtypes)[c] == "boolean" else F.col(c).cast("double")
        aggs += [F.avg(x).alias(c), F.stddev_samp(x).alias(f"{c}_std")]
    aggs += [F.min_by(c, trial).alias(c) for c in others]
    aggs.append(F.max_by(trial, F.struct(F.col("reward"), -F.col(trial))).alias("best_trial"))
    return results.groupBy(task).agg(*aggs)


def over_seeds(results: DataFrame, numbers: list[str], seed: str = "seed") -> DataFrame:
    """Mean and deviation over seeds of each seed's mean; the deviation of one seed is 0."""
    per = results.groupBy(seed).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numbers])
    aggs = [F.count(F.lit(1)).alias("n_seeds")]
    for c in numbers:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    return per.agg(*aggs)


def costs(results: DataFrame, agent: str = "agent_cost", simulator: str = "user_simulator_cost") -> DataFrame:
    """One row: cost of agents, of simulated users and of both over all results; an absent cost is 0."""
    a, u = (F.coalesce(F.sum(c), F.lit(0.0)) for c in (agent, simulator))
    return results.agg(a.alias(agent), u.alias(simulator), (a + u).alias("total_cost"))


def elicitation(total: Column, revealed: Column) -> Column:
    """Share of the keys that were revealed; 1 if there are none."""
    return F.when(F.size(total) > 0, F.size(F.array_intersect(total, revealed)) / F.size(F.array_distinct(total))).otherwise(1.0)


def triggered(messages: DataFrame, triggers: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Messages with ``triggers``: names of the triggers of which a keyword stands in the message."""
    low = F.lower(F.col(text))
    hits = [
        F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in words]), F.lit(name)) for name, words in sorted(triggers.items()) if words
    ]
    return messages.withColumn("triggers", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))


def revealed(messages: DataFrame, plan: DataFrame, triggers: dict[str, list[str]], conversation: str = "task_id") -> DataFrame:
    """(task_id, n_keys, n_revealed, completeness): which keys of a plan (task_id, trigger, key) the agent's messages drew out.

    Keys without a trigger are told at once. A task without keys has no row.
    """
    fired = triggered(messages, triggers).select(conversation, F.explode("triggers").alias("trigger")).distinct().withColumn("fired", F.lit(1))
    keys = plan.join(fired, [conversation, "trigger"], "left")
    told = F.col("trigger").isNull() | F.col("fired").isNotNull()
    per = keys.groupBy(conversation, "key").agg(F.max(told).alias("told"))
    return per.groupBy(conversation).agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("told")).alias("n_revealed"), F.avg(F.col("told").cast("double")).alias("completeness")
    )
