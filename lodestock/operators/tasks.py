"""Generation of tasks: constraint sampling on a pool index, soft preferences, assembly, summaries.

Sampling is driver work on counts that one scan made (``PoolIndex``); the catalogue isn't read again.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestock.model import Bracket, ConstraintSpec
from lodestock.operators.calibrate import PoolIndex


def value_weights(freq: dict[str, float], used: Counter, decay: float = 0.5) -> dict[str, float]:
    """Weight of each value: its frequency, less the oftener it was used."""
    return {v: max(f, 1e-6) / (1.0 + decay * used[v]) for v, f in freq.items()}


def constraint_weight(probability: float, times: int, made: int) -> float:
    """Sampling weight of a constraint that ``times`` of ``made`` tasks hold: raised if under-used, lowered if over-used, after five tasks."""
    if made >= 5 and times / made < probability * 0.5:
        probability = min(probability * 1.5, 0.95)
    elif made >= 5 and times / made > probability * 2.0:
        probability = max(probability * 0.7, 0.05)
    return max(probability, 0.01)


def _draw(rng: random.Random, weights: dict[str, float]) -> str:
    names = sorted(weights)
    return rng.choices(names, [weights[n] for n in names])[0]


def sample_constraints(
    index: PoolIndex, registry: list[ConstraintSpec], bracket: Bracket, rng: random.Random, frequencies: dict[str, dict[str, float]] | None = None,
    used: Counter | None = None, coherent=lambda c: True, tries: int = 60, made: int = 0,
) -> tuple[dict[str, Any], int] | None:
    """A constraint set with its pool size inside the bracket, grown one constraint at a time toward its middle; None if not found.

    ``used`` counts the ``name=value`` of the ``made`` tasks so far.
    """
    used = used if used is not None else Counter()
    by_name = {c.name: c for c in registry if any(n == c.name for n, _ in index.bit)}
    times = Counter()
    for pair, n in used.items():
        times[pair.split("=", 1)[0]] += n
    weight = {n: constraint_weight(c.sampling_probability, times[n], made) for n, c in by_name.items()}
    mid = (bracket.lo + bracket.hi) / 2
    for _ in range(tries):
        chosen: dict[str, Any] = {}
        size = None
        for name in [n for n, c in by_name.items() if c.always_include]:
            chosen[name] = _pick(rng, name, index, frequencies, used)
        while len(chosen) < len(by_name):
            open_names = {n: w for n, w in weight.items() if n not in chosen}
            name = _draw(rng, open_names)
            trial = chosen | {name: _pick(rng, name, index, frequencies, used)}
            size_now = index.size(trial)
            if size_now < bracket.lo or not coherent(trial):
                if rng.random() < 0.3:
                    break
                continue
            # A step is kept with less chance the farther the pool still is from the middle.
            if rng.random() > max(0.3, 1 - 0.5 * abs(size_now - mid) / max(bracket.hi, 1)):
                continue
            chosen, size = trial, size_now
            if len(chosen) >= bracket.min_constraints and bracket.lo <= size <= bracket.hi:
                used.update(f"{n}={v}" for n, v in chosen.items())
                return chosen, size
    return None


def _pick(rng: random.Random, name: str, index: PoolIndex, frequencies, used: Counter) -> str:
    values = [v for n, v in index.bit if n == name]
    freq = (frequencies or {}).get(name) or dict.fromkeys(values, 1.0)
    own = Counter({v: used[f"{name}={v}"] for v in values})
    return _draw(rng, value_weights({v: freq.get(v, 1e-6) for v in values}, own))


def tightened(index: PoolIndex, chosen: dict[str, Any], target: int) -> dict[str, Any]:
    """The set made harder, value by value, until its pool is at most ``target``: the over-constrained tasks."""
    out = dict(chosen)
    for name in sorted({n for n, _ in index.bit}):
        sizes = {v: index.size(out | {name: v}) for n, v in index.bit if n == name}
        v = min(sorted(sizes), key=lambda x: abs(sizes[x] - target))
        if sizes[v] < index.size(out):
            out[name] = v
        if index.size(out) <= target:
            break
    return out


def _over_constrained(index: PoolIndex, registry: list[ConstraintSpec], bracket: Bracket, base: Bracket, rng: random.Random, tries: int = 80, **sampling) -> tuple[dict[str, Any], int] | None:
    """A set of the base bracket with one constraint added or changed so that its pool falls into the bracket; None if not found."""
    for _ in range(tries):
        found = sample_constraints(index, registry, base, rng, used=Counter(sampling["used"]), tries=10, **{k: v for k, v in sampling.items() if k != "used"})
        if found is None:
            continue
        pairs = sorted((n, v) for n, v in index.bit if found[0].get(n) != v)
        rng.shuffle(pairs)
        for n, v in pairs:
            trial = found[0] | {n: v}
            if bracket.lo <= index.size(trial) <= bracket.hi:
                return trial, index.size(trial)
    return None


def generate(
    index: PoolIndex, registry: list[ConstraintSpec], brackets: list[Bracket], rng: random.Random,
    accept: Callable[[str, dict[str, Any], int], dict[str, Any] | str] = lambda tier, constraints, size: {},
    frequencies: dict[str, dict[str, float]] | None = None, coherent=lambda c: True, per_target: int = 12,
) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """(tasks, rejections) until every tier has its target or ``per_target`` attempts a wanted task are spent.

    Each attempt draws a tier by its shortfall. Tiers of pools of up to 3 change one constraint of a set of the ``medium`` tier.
    ``accept`` completes a task (profile, anchor: injected) or names the reason of its rejection; of equal ``initial_query``
    the first stands. Rejections have attempt, tier and reason. Only accepted tasks weigh on later draws.
    """
    by_tier = {b.tier: b for b in brackets}
    made, done, rejected = [], Counter(), []
    used, queries = Counter(), set()
    for attempt in range(1, per_target * sum(b.target for b in brackets) + 1):
        short = {t: b.target - done[t] for t, b in by_tier.items() if done[t] < b.target}
        if not short:
            break
        tier = _draw(rng, short)
        bracket = by_tier[tier]
        sampling = {"frequencies": frequencies, "used": Counter(used), "coherent": coherent, "made": len(made)}
        if bracket.hi <= 3 and "medium" in by_tier:
            found = _over_constrained(index, registry, bracket, by_tier["medium"], rng, **sampling)
        else:
            found = sample_constraints(index, registry, bracket, rng, **sampling)
        more = accept(tier, *found) if found else "constraint_sampling"
        query = more.get("initial_query", "").lower().strip() if isinstance(more, dict) else ""
        if query and query in queries:
            more = "query_duplicate"
        if isinstance(more, str):
            rejected.append({"attempt": attempt, "difficulty": tier, "reason": more})
            continue
        queries.add(query)
        done[tier] += 1
        used.update(f"{n}={v}" for n, v in found[0].items())
        made.append({"difficulty": tier, "hard_constraints": found[0], "pool_size": found[1], "n_constraints": len(found[0])} | more)
    return made, rejected


def rejection_counts(rejections: DataFrame) -> DataFrame:
    """(reason, n) of (attempt, difficulty, reason)."""
    return rejections.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def preference_variance(pool: DataFrame, numbers: list[str], matches: dict[str, str]) -> DataFrame:
    """(attribute, kind, measure, usable): numbers need a range, match targets a share of 5 to 95 % of the pool."""
    cells = []
    for c in numbers:
        x = F.col(f"`{c}`").cast("double")
        spread = F.coalesce(F.max(x) - F.min(x), F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("attribute"), F.lit("range").alias("kind"), spread.alias("measure"), (spread > 0).alias("usable")))
    for c, v in matches.items():
        share = F.coalesce(F.avg((F.lower(F.col(f"`{c}`").cast("string")) == v.lower()).cast("double")), F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("attribute"), F.lit("match").alias("kind"), share.alias("measure"), share.between(0.05, 0.95).alias("usable")))
    return pool.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def description_candidates(pool: DataFrame, described: DataFrame, key: str, least: int = 20, most: float = 0.4) -> DataFrame:
    """(attr, value, n) usable as description constraints: frequent enough, and leaving most of the pool out."""
    ids = pool.select(F.col(key).alias("pid"))
    n = described.join(ids, "pid", "left_semi").groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("all_")))).where((F.col("n") >= least) & (F.col("n") <= F.lit(most) * F.col("all_"))).drop("all_")


def generation_summary(tasks: DataFrame, targets: DataFrame, tier: str = "difficulty") -> DataFrame:
    """Per tier: tasks against target, pool min, median and max, mean constraints."""
    per = tasks.groupBy(tier).agg(
        F.count(F.lit(1)).alias("n"), F.min("pool_size").alias("pool_min"), F.percentile("pool_size", F.lit(0.5)).alias("pool_median"), F.max("pool_size").alias("pool_max"),
        F.avg(F.col("n_constraints").cast("double")).alias("mean_constraints"),
    )
    return targets.join(per, tier, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def diversity(tasks: DataFrame, constraints: str = "hard_constraints") -> DataFrame:
    """(name, value, n) over the constraint maps of all tasks."""
    return tasks.select(F.explode(constraints).alias("name", "value")).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def preference_pairs(tasks: DataFrame, preferences: str = "attribute_preferences") -> DataFrame:
    """(attribute, direction, n) over the preferences of all tasks, an array of structs with attribute and direction; absent ones count as empty."""
    p = tasks.select(F.explode(preferences).alias("p"))
    return p.groupBy(*[F.coalesce(f"p.{c}", F.lit("")).alias(c) for c in ("attribute", "direction")]).agg(F.count(F.lit(1)).alias("n"))


def preference_combos(tasks: DataFrame, preferences: str = "attribute_preferences") -> DataFrame:
    """(combo, n): tasks by their set of preferences, written ``attribute:direction|...`` in order; tasks without any are left out."""
    pair = lambda p: F.struct(*[F.coalesce(p[c], F.lit("")).alias(c) for c in ("attribute", "direction")])
    ordered = F.array_sort(F.transform(preferences, pair))
    combo = F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p["attribute"], p["direction"])), "|")
    return tasks.where(F.size(preferences) > 0).groupBy(combo.alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def dedup_queries(tasks: DataFrame, query: str, order: Column) -> DataFrame:
    """The first task of each query, whatever its letter case and surrounding blanks."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lower(F.trim(F.col(query)))).orderBy(order)
    return tasks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def inverted_triggers(preferences: DataFrame) -> DataFrame:
    """(trigger, attributes) of (attribute, trigger)."""
    return preferences.where("trigger is not null").groupBy("trigger").agg(F.array_sort(F.collect_set("attribute")).alias("attributes"))


def first_trigger(triggers: DataFrame) -> DataFrame:
    """(key, trigger): the trigger that names a key first, of (trigger, pos, keys)."""
    return triggers.select("trigger", "pos", F.explode("keys").alias("key")).groupBy("key").agg(F.min_by("trigger", F.struct("pos", "trigger")).alias("trigger"))
