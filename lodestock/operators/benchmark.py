"""A benchmark from end to end: catalogue, tasks with constraints, policies as plug-ins, evaluation, report.

Constraint values of tasks are matched with the registry's sampling values; a product's answers to all of
those (attribute, operator, value) questions are the bits of its signature, a task's constraints the bits it
requires. Tasks with the same requirement are one set, products with the same signature one group, so sets meet
groups and not tasks products: pools, their ranges and the best of each group come from that one small join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestock.model import ConstraintSpec
from lodestock.operators.calibrate import candidates
from lodestock.operators.scoring import reward
from lodestock.sources.shared import keep, small

BITS = 62  # of a long


@dataclass
class Run:
    """What a policy gets: products (pid, price, popularity, signature), sets of requirements, and which groups satisfy which sets."""

    products: DataFrame
    sets: DataFrame
    signature: list[str]

    def satisfies(self, required: str = "r", held: str = "s") -> Column:
        """Whether the held bits include the required ones; a requirement of nothing is always met."""
        pairs = [(F.col(f"{required}{i}"), F.col(f"{held}{i}")) for i in range(len(self.signature))]
        return reduce(Column.__and__, [s.bitwiseAND(r) == r for r, s in pairs])


Policy = Callable[[Run, int], DataFrame]  # (set_id, pos, pid): k products for each set, in order


def registry_of(specs: DataFrame, domain: str, max_specs: int = 10_000) -> list[ConstraintSpec]:
    """The structured constraints of a domain, from a table of specifications."""
    rows = small(specs.where((F.col("domain") == domain) & F.col("operator").isNotNull()), max_specs, "constraint specifications")
    return [ConstraintSpec(r.name, r.attribute, r.operator, sampling_values=[v for v in r.sampling_values or [] if v is not None], desc_constraint=bool(r.desc_constraint)) for r in rows]


def _plain(value: Column) -> Column:
    """A value to compare by: a number's shortest form, else trimmed lower case."""
    text = F.lower(F.trim(value))
    return F.coalesce(text.try_cast("double").cast("string"), text)


def required(tasks: DataFrame, registry: list[ConstraintSpec], known: list[tuple[str, str]]) -> DataFrame:
    """(task_id, difficulty, infeasible, r0, r1, ...): the last delivery of each task with the bits it requires.

    Values that are none of the registry's (other than by letter case, blanks or the form of a number) and
    constraints it doesn't know require nothing. Tasks without an id are left out.
    """
    spark = tasks.sparkSession
    last = tasks.where("task_id is not null").groupBy("task_id").agg(F.max_by(F.struct("difficulty", "infeasible", F.col("user_profile.hard_constraints").alias("c")), F.struct("ingested_at", "difficulty")).alias("x"))
    last = last.select("task_id", "x.difficulty", "x.infeasible", "x.c")
    bits = spark.createDataFrame([(n, v, i // BITS, 1 << (i % BITS)) for i, (n, v) in enumerate(known)], "name string, value string, word int, bit long")
    bits = bits.select("name", _plain(F.col("value")).alias("plain"), "word", "bit")
    words = max(1, -(-len(known) // BITS))
    asked = last.select("task_id", F.explode("c").alias("name", "value")).select("task_id", "name", _plain(F.col("value")).alias("plain"))
    met = asked.join(F.broadcast(bits), ["name", "plain"])  # one row per registry value
    per = met.groupBy("task_id").agg(*[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"r{i}") for i in range(words)])
    return last.drop("c").join(per, "task_id", "left").select("task_id", "difficulty", "infeasible", *[F.coalesce(f"r{i}", F.lit(0).cast("long")).alias(f"r{i}") for i in range(words)])


def prepare(catalog: DataFrame, tasks: DataFrame, registry: list[ConstraintSpec], product: str, price: str, popularity: str) -> tuple[Run, DataFrame]:
    """(run, tasks with their set_id). Products without a price take part but are nobody's cheapest."""
    found = candidates(catalog, registry)
    words = max(1, -(-len(found) // BITS))
    keys = [
        reduce(Column.__add__, [F.when(m, F.lit(1 << (i % BITS))).otherwise(F.lit(0)).cast("long") for i, (_, _, m) in enumerate(found) if i // BITS == k], F.lit(0).cast("long")).alias(f"s{k}")
        for k in range(words)
    ]
    cost = F.col(f"`{price}`").cast("double")
    products = keep(catalog.select(F.col(f"`{product}`").alias("pid"), F.when(~F.isnan(cost), cost).alias("price"), F.col(f"`{popularity}`").cast("double").alias("popularity"), *keys), "products")
    names = [f"r{k}" for k in range(words)]
    asked = keep(required(tasks, registry, [(n, str(v)) for n, v, _ in found]).withColumn("set_id", F.concat_ws("-", *[F.hex(n) for n in names])), "asked")
    sets = keep(asked.select("set_id", *names).distinct(), "sets")
    return Run(products, sets, [f"s{k}" for k in range(words)]), asked


def pools(run: Run) -> DataFrame:
    """(set_id, pool_size, low_price, high_price) of every set, 0 where nothing satisfies it."""
    groups = run.products.groupBy(*run.signature).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    met = run.sets.join(groups, run.satisfies())
    per = met.groupBy("set_id").agg(F.sum("n").alias("pool_size"), F.min("lo").alias("low_price"), F.max("hi").alias("high_price"))
    return run.sets.select("set_id").join(per, "set_id", "left").withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))


def cheapest(run: Run, k: int) -> DataFrame:
    """Policy: the k cheapest products that satisfy the set; ties by id. Each group keeps its k cheapest before sets are met."""
    order = Window.partitionBy(*run.signature).orderBy("price", "pid")
    best = run.products.where("price is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    met = run.sets.join(best, run.satisfies())
    pos = F.row_number().over(Window.partitionBy("set_id").orderBy("price", "pid"))
    return met.withColumn("pos", pos).where(F.col("pos") <= k).select("set_id", "pos", "pid")


def popular(run: Run, k: int) -> DataFrame:
    """Policy: the k most popular products whatever is asked; ties by id."""
    top = run.products.orderBy(F.col("popularity").desc_nulls_last(), "pid").limit(k)
    placed = top.select("pid", F.row_number().over(Window.orderBy(F.col("popularity").desc_nulls_last(), "pid")).alias("pos"))  # k rows
    return run.sets.select("set_id").crossJoin(F.broadcast(placed)).select("set_id", "pos", "pid")


POLICIES: dict[str, Policy] = {"cheapest": cheapest, "popular": popular}


def evaluate(run: Run, asked: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(task_id, difficulty, infeasible, pool_size, n, csr, reward) of every task.

    csr is the share of recommendations that satisfy the task, 1 for none. The reward is that of the best
    satisfying one by price within the pool; a task without a pool is declared infeasible, and rewarded if it is.
    """
    p = run.products.select("pid", F.col("price"), *run.signature)
    held = recommendations.join(p, "pid").join(run.sets, "set_id")
    ok = run.satisfies()
    per = held.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"), F.min(F.when(ok, F.col("price"))).alias("best_price"))
    size = pools(run).join(per, "set_id", "left")
    span = F.col("high_price") - F.col("low_price")
    utility = F.when(F.col("best_price").isNull(), None).when(span == 0, 1.0).otherwise((F.col("high_price") - F.col("best_price")) / span)
    low = F.when(span == 0, 1.0).otherwise(0.0)
    scored = size.select(
        "set_id", "pool_size", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.col("good") / F.col("n")).otherwise(1.0).alias("csr"),
        reward(utility, low, F.lit(1.0), F.coalesce("good", F.lit(0)) > 0).alias("earned"),
    )
    told = F.when(F.coalesce("infeasible", F.lit(False)), 1.0).otherwise(0.0)
    return asked.join(scored, "set_id").select("task_id", "difficulty", "infeasible", "pool_size", "n", "csr", F.when(F.col("pool_size") == 0, told).otherwise(F.col("earned")).alias("reward"))


def report(results: DataFrame) -> DataFrame:
    """Over all tasks and by difficulty: tasks, those without a pool, mean pool, csr and reward; by ``policy`` if there are several."""
    by = ["policy"] if "policy" in results.columns else []
    marked = results.withColumn("difficulty", F.coalesce("difficulty", F.lit("(none)")))
    rolled = marked.groupingSets([[*[F.col(c) for c in by]], [*[F.col(c) for c in by], F.col("difficulty")]], *[F.col(c) for c in by], F.col("difficulty"))
    return rolled.agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("pool_size") == 0).alias("n_empty"), F.avg("pool_size").alias("mean_pool"), F.avg("csr").alias("csr"), F.avg("reward").alias("reward")
    )


class Benchmark:
    """``Benchmark(catalogue, tasks, registry, ...).run("cheapest")`` gives results by task, ``.report(...)`` the tables of policies."""

    def __init__(self, catalog: DataFrame, tasks: DataFrame, registry: list[ConstraintSpec], *, product: str, price: str, popularity: str):
        self._run, self.tasks = prepare(catalog, tasks, registry, product, price, popularity)

    def run(self, policy: str | Policy, k: int = 3) -> DataFrame:
        chosen = POLICIES[policy] if isinstance(policy, str) else policy
        return evaluate(self._run, self.tasks, chosen(self._run, k))

    def report(self, policies: dict[str, Policy] | list[str], k: int = 3) -> DataFrame:
        named = policies if isinstance(policies, dict) else {p: POLICIES[p] for p in policies}
        return report(reduce(DataFrame.unionByName, [self.run(f, k).withColumn("policy", F.lit(n)) for n, f in named.items()]))
