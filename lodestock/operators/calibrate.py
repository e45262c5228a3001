"""Hit rates of constraint values, pool sizes of many constraint sets in one scan, brackets, calibration."""

from __future__ import annotations

import random
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestock.fixed import PRUNED_VALUES
from lodestock.model import Bracket, ConstraintSpec
from lodestock.operators.predicates import mask
from lodestock.sources.shared import keep



def candidates(df: DataFrame, registry: list[ConstraintSpec]) -> list[tuple[str, Any, Column]]:
    """(constraint, value, mask) of every sampling value of structured constraints over known columns."""
    return [
        (c.name, v, mask(F.col(f"`{c.attribute}`"), df.schema[c.attribute].dataType, c.operator, v))
        for c in registry
        if not c.desc_constraint and c.attribute in df.columns
        for v in c.sampling_values or []
    ]


def hit_rates(df: DataFrame, registry: list[ConstraintSpec], per_scan: int = 60) -> DataFrame:
    """(name, value, hits, rate) of every sampling value, by conditional counts: one scan for ``per_scan`` values."""
    found = candidates(df, registry)
    parts = []
    for at in range(0, len(found), per_scan):
        cells = [
            F.struct(F.lit(n).alias("name"), F.lit(str(v)).alias("value"), F.count_if(m).alias("hits"), F.avg(m.cast("double")).alias("rate"))
            for n, v, m in found[at : at + per_scan]
        ]
        parts.append(df.agg(F.array(*cells).alias("a")).select(F.inline("a")))
    if not parts:
        return df.sparkSession.createDataFrame([], "name string, value string, hits long, rate double")
    return reduce(DataFrame.unionByName, parts)


def pruned(rates: DataFrame, least: float = 0.005, garbage: tuple[str, ...] = PRUNED_VALUES) -> DataFrame:
    """Values worth sampling: no garbage and matching at least a share of rows."""
    return rates.where(~F.lower(F.trim("value")).isin(*garbage) & (F.coalesce("rate", F.lit(0.0)) >= least))


def viability(kept: DataFrame, names: list[str]) -> DataFrame:
    """(name, n_values, viable): at least two values must be left."""
    every = kept.sparkSession.createDataFrame([(n,) for n in names], "name string")
    n = kept.groupBy("name").agg(F.count(F.lit(1)).alias("n_values"))
    return every.join(n, "name", "left").select("name", F.coalesce("n_values", F.lit(0)).alias("n_values"), (F.coalesce("n_values", F.lit(0)) >= 2).alias("viable"))


def restrictiveness(rates: DataFrame) -> DataFrame:
    """Median hit rate of each constraint's values: small means restrictive."""
    return rates.groupBy("name").agg(F.percentile("rate", F.lit(0.5)).alias("restrictiveness"))


def pool_sizes(df: DataFrame, sets: dict[str, list[Column]]) -> DataFrame:
    """(set_id, pool_size) of many conjunctions, counted in one scan."""
    cells = [F.struct(F.lit(k).alias("set_id"), F.count_if(reduce(lambda a, b: a & b, ms, F.lit(True))).alias("pool_size")) for k, ms in sets.items()]
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def signatures(df: DataFrame, masks: list[Column]) -> DataFrame:
    """(signature, n): which masks hold, as bits of a long, and how many rows share that. Up to 62 masks."""
    if len(masks) > 62:
        raise ValueError("a signature holds up to 62 masks; split them")
    bits = reduce(lambda a, b: a + b, [F.when(m, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, m in enumerate(masks)], F.lit(0).cast("long"))
    return df.select(bits.alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


class PoolIndex:
    """Pool sizes of any conjunction of known (constraint, value) pairs, from the counts of signatures.

    The scan happens once. Signatures come to the driver if there are at most ``max_signatures``; more stay a table in
    the shared folder, and each size is a filtered sum over it.
    """

    def __init__(self, df: DataFrame, registry: list[ConstraintSpec], max_signatures: int = 200_000):
        self.found = candidates(df, registry)
        self.bit = {(n, str(v)): i for i, (n, v, _) in enumerate(self.found)}
        groups = [self.found[i : i + 62] for i in range(0, len(self.found), 62)]
        keys = [reduce(lambda a, b: a + b, [F.when(m, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, _, m) in enumerate(g)]).alias(f"s{k}") for k, g in enumerate(groups)]
        counts = df.select(*keys).groupBy(*[f"s{k}" for k in range(len(groups))]).agg(F.count(F.lit(1)).alias("n"))
        self.words, self.table = len(groups), None
        few = counts.limit(max_signatures + 1).collect()
        self.rows = [(sum(int(r[k]) << (62 * k) for k in range(self.words)), int(r["n"])) for r in few]
        if len(few) > max_signatures:
            self.rows, self.table = [], keep(counts, "signatures")

    def size(self, constraints: dict[str, Any]) -> int:
        want = sum(1 << self.bit[(n, str(v))] for n, v in constraints.items())
        if self.table is not None:
            parts = [F.lit(want >> (62 * k) & (1 << 62) - 1) for k in range(self.words)]
            held = reduce(lambda a, b: a & b, [F.col(f"s{k}").bitwiseAND(p) == p for k, p in enumerate(parts)])
            return self.table.where(held).agg(F.sum("n")).first()[0] or 0
        return sum(n for s, n in self.rows if s & want == want)


def calibration(pools: DataFrame) -> DataFrame:
    """One row from (pool_size): percentiles, share of empty pools and of pools of 1 to 3."""
    p = [5, 10, 25, 50, 75, 90, 95]
    q = F.percentile("pool_size", F.array(*[F.lit(x / 100) for x in p]))
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return pools.agg(
        F.count(F.lit(1)).alias("n_samples"), *[q[i].alias(f"p{x}") for i, x in enumerate(p)],
        (F.count_if(F.col("pool_size") == 0) / n).alias("zero_rate"), (F.count_if(F.col("pool_size").between(1, 3)) / n).alias("small_rate"),
    )


def marginal_effects(samples: DataFrame, names: list[str]) -> DataFrame:
    """Per constraint: median pool with and without it and the reduction; samples has (pool_size, names array)."""
    cells = []
    for c in names:
        has = F.array_contains("names", c)
        w, wo = F.percentile(F.when(has, F.col("pool_size")), F.lit(0.5)), F.percentile(F.when(~has, F.col("pool_size")), F.lit(0.5))
        cells.append(
            F.struct(
                F.lit(c).alias("name"), w.alias("median_with"), wo.alias("median_without"), (F.lit(1.0) - w / F.greatest(wo, F.lit(1.0))).alias("reduction"),
                F.count_if(has).alias("n_with"), F.count_if(~has).alias("n_without"),
            )
        )
    return samples.agg(F.array(*cells).alias("a")).select(F.inline("a")).where("n_with > 0 and n_without > 0")


def brackets_of(catalog_size: int, total: int = 250) -> list[Bracket]:
    """Difficulty brackets as shares of the catalogue's size, with floors for small ones."""
    n = max(catalog_size, 100)

    def part(least: int, share: float) -> int:
        return max(least, int(n * share))

    return [
        Bracket("small", part(20, 0.002), part(80, 0.010), 3, 0.35, max(1, int(total * 0.30))),
        Bracket("medium", part(8, 0.0005), part(40, 0.003), 4, 0.50, max(1, int(total * 0.30))),
        Bracket("large", part(3, 0.0001), part(15, 0.001), 5, 0.65, max(1, int(total * 0.20))),
        Bracket("oc_feasible", 1, 3, 4, 0.15, max(1, int(total * 0.10))),
        Bracket("oc_infeasible", 0, 0, 4, 0.15, max(1, int(total * 0.10))),
    ]


def bracket_table(spark, brackets: list[Bracket]) -> DataFrame:
    return spark.createDataFrame([(b.tier, b.lo, b.hi, b.min_constraints, b.target) for b in brackets], "tier string, lo long, hi long, min_constraints long, target long")


def bracket_coverage(pools: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """Per tier: pools in its range, their share, and whether they are twice the target. Ranges may overlap."""
    table = bracket_table(pools.sparkSession, brackets)
    n = F.col("all_")
    hits = table.join(pools, pools["pool_size"].between(table["lo"], table["hi"]), "left").groupBy("tier", "target").agg(F.count("pool_size").alias("viable"))
    return hits.crossJoin(F.broadcast(pools.agg(F.count(F.lit(1)).alias("all_")))).select(
        "tier", "target", "viable", (F.col("viable") / F.greatest(n, F.lit(1))).alias("coverage"), (F.col("viable") >= F.col("target") * 2).alias("sufficient")
    )


def tuned(pools: DataFrame) -> DataFrame:
    """(tier, lo, hi) proposed from the 20, 40, 60 and 80 % points of pools above 3; no row if there are none."""
    q = F.percentile("pool_size", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)]))
    p = pools.where("pool_size > 3").agg(F.count(F.lit(1)).alias("n"), *[F.floor(q[i]).alias(f"p{20 * (i + 1)}") for i in range(4)]).where("n > 0")
    g, c = F.greatest, F.col
    rows = {
        "large": (F.lit(4), g(c("p20"), F.lit(5))),
        "medium": (g(c("p20") - 2, F.lit(4)), g(c("p40") + 5, c("p20") + 5)),
        "small": (g(c("p40") - 5, c("p20")), g(c("p80"), c("p40") + 10)),
        "oc_feasible": (F.lit(1), F.lit(3)),
        "oc_infeasible": (F.lit(0), F.lit(0)),
    }
    return p.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tier"), a.cast("long").alias("lo"), b.cast("long").alias("hi")) for t, (a, b) in rows.items()])))


def best_count(pools: DataFrame, lo: int, hi: int) -> DataFrame:
    """The constraint count k whose pools fit best: share in [lo, hi] less 0.01 times the distance of the median from the middle."""
    mid = (lo + hi) / 2
    per = pools.groupBy("k").agg(F.percentile("pool_size", F.lit(0.5)).alias("median"), F.avg(F.col("pool_size").between(lo, hi).cast("double")).alias("inside"))
    scored = per.withColumn("score", F.col("inside") - F.lit(0.01) * F.abs(F.col("median") - mid) / F.greatest(F.lit(mid), F.lit(1.0)))
    return scored.agg(F.max_by(F.struct("k", "median", "inside", "score"), F.struct("score", -F.col("k"))).alias("b")).select("b.*")


def initial_probabilities(rates: DataFrame, weights: dict[str, tuple[float, bool]], mean: float = 4.0) -> dict[str, float]:
    """Sampling probability of each constraint from its weight: rare matches are toned down, the sum is scaled to the mean."""
    out, raw = {}, {}
    for r in small(restrictiveness(rates), 10_000, "constraints"):
        w, always = weights.get(r.name, (2.0, False))
        if always:
            out[r.name] = 1.0
        else:
            raw[r.name] = w * (0.4 if r.restrictiveness < 0.02 else 0.7 if r.restrictiveness < 0.05 else 1.0)
    scale = max(mean - len(out), 1.0) / (sum(raw.values()) or 1.0)
    return out | {n: min(max(w * scale, 0.05), 0.90) for n, w in raw.items()}


def calibrated(index: PoolIndex, probabilities: dict[str, float], restrictive: dict[str, float], *, mean: float = 4.0, zero_rate: float = 0.12, samples: int = 400, rounds: int = 5, seed: int = 0) -> dict[str, float]:
    """Probabilities adjusted until sampled sets are rarely unsatisfiable and about as long as wanted; reads the index only."""
    values: dict[str, list[str]] = {}
    for n, v in index.bit:
        values.setdefault(n, []).append(v)
    p = {n: x for n, x in probabilities.items() if n in values}
    loose = sorted((n for n in p if p[n] < 1.0), key=lambda n: (restrictive.get(n, 1.0), n))
    for turn in range(rounds):
        rng = random.Random(seed + turn)
        empty, length = 0, 0
        for _ in range(samples):
            chosen = {n: rng.choice(values[n]) for n in sorted(p) if p[n] >= 1.0 or rng.random() < p[n]}
            length += len(chosen)
            empty += bool(chosen) and index.size(chosen) == 0
        got, empty_rate = length / samples, empty / samples
        if empty_rate <= 1.3 * zero_rate and abs(got - mean) < 0.8:
            break
        if empty_rate > zero_rate:
            for i, n in enumerate(loose):
                p[n] = max(p[n] * (0.75 if i < len(loose) // 2 else 0.90), 0.05)
        if abs(got - mean) > 0.8:
            for n in loose:
                p[n] = min(max(p[n] * mean / max(got, 0.1), 0.05), 0.90)
    return p
