"""Samples whose categories match target proportions.

The quota of a plan goes down its category tree (the root, absent or stated, the value's family, the
value). At each node it is shared among the children in proportion to their targets, between each
child's floor (what its leaves must keep) and capacity (what its leaves have). What a child can't take
goes to its siblings first; only what a whole subtree can't take reaches its parent's other children,
the cousins. Every task has one category of a plan before capacities are counted, so the quotas can be
drawn in full.

Leaves draw by dense rank under a permutation of the record ids: the rank comes from the counts of
hash buckets, whose number follows the category's size, and from a sort inside each bucket. A category
draws to its own target, then to the quota it was allocated; a target is unmet where the first draw
ends before it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestock.sources.shared import small

ABSENT = "(absent)"
BUCKET_ROWS = 50_000  # tasks that one sort takes, about


class _Node:
    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.weight = 0.0
        self.floor = 0
        self.capacity = 0
        self.leaf: str | None = None


def _share(quota: int, nodes: list[_Node]) -> list[int]:
    """Whole numbers that sum to the quota (or to the capacity), between floors and capacities, in proportion to weights."""
    quota = min(quota, sum(n.capacity for n in nodes))
    floors = [n.floor for n in nodes]
    if sum(floors) >= quota:  # floors that can't all be kept shrink alike
        total = sum(floors) or 1
        exact = [f * quota / total for f in floors]
        tops = floors
    else:
        # x = clamp(scale * weight, floor, capacity) rises with the scale: halve until it meets the quota.
        weights = [n.weight for n in nodes]
        if not sum(w for w, n in zip(weights, nodes) if n.capacity > n.floor):
            weights = [1.0] * len(nodes)
        weights = [w / max(weights) for w in weights]  # the search below needs comparable scales
        tops = [n.capacity for n in nodes]
        # Without weight a node keeps its floor until the weighted ones are full.
        full = sum(t if w else f for f, t, w in zip(floors, tops, weights))
        if full < quota:
            weights = [w or 1e-9 for w in weights]
        weights = [w and max(w, 1e-9) for w in weights]
        lo, hi = 0.0, max(t / w for t, w in zip(tops, weights) if w) + 1.0

        def at(scale: float) -> list[float]:
            return [min(max(scale * w, f), t) for w, f, t in zip(weights, floors, tops)]

        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(at(mid)) < quota else (lo, mid)
        exact = at(hi)
    out = [min(int(math.floor(x + 1e-9)), t) for x, t in zip(exact, tops)]
    order = sorted(range(len(nodes)), key=lambda i: (-(exact[i] - out[i]), i))
    left = quota - sum(out)
    while left < 0:  # rounding up by the tolerance
        i = next(i for i in reversed(order) if out[i] > 0)
        out[i] -= 1
        left += 1
    while left > 0:
        step = [i for i in order if out[i] < tops[i]]
        if not step:
            break
        for i in step[:left]:
            out[i] += 1
            left -= 1
    return out


def allocate(size: int, leaves: list[tuple[tuple[str, ...], float, int, int]]) -> dict[tuple[str, ...], int]:
    """Quota of each leaf. leaves: (path from the root, target share, minimum, available)."""
    root = _Node()
    for path, weight, least, available in sorted(leaves):
        node = root
        floor = min(least, available)
        for step in ("", *path):
            if step or node is not root:
                node = node.children.setdefault(step, _Node())
            node.weight += weight
            node.floor += floor
            node.capacity += available
        node.leaf = path
    out: dict[tuple[str, ...], int] = {}

    def down(node: _Node, quota: int) -> None:
        if node.leaf is not None and not node.children:
            out[node.leaf] = quota
            return
        children = [node.children[k] for k in sorted(node.children)]
        for child, q in zip(children, _share(quota, children)):
            down(child, q)

    down(root, min(size, root.capacity))
    return out


def category_key(value: Column) -> Column:
    """The value without white space around it and in lower case."""
    return F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def plan_candidates(tasks: DataFrame, targets: DataFrame, max_targets: int = 100_000) -> DataFrame:
    """(plan_id, category, task_id, own) of the tasks of a plan's domain that belong to one of its categories.

    A task without the plan's key, or with a null value or null map, is in ``(absent)``; a value that
    equals no category belongs to none. Tasks without an id are left out. A task whose deliveries name
    several categories has a row for each; it is drawn for its own, that of its last delivery (ties: the
    last category in code point order). More than ``max_targets`` target rows are an error.
    """
    small(targets.select("plan_id"), max_targets, "targets")
    plans = targets.select("plan_id", "domain", "constraint_name").distinct()
    wanted = targets.select("plan_id", "category", F.when(F.col("category") == ABSENT, F.lit(ABSENT)).otherwise(category_key(F.col("category"))).alias("key")).distinct()
    t = tasks.where("task_id is not null").select(
        "task_id", "domain", F.col("user_profile.hard_constraints").alias("constraints"), "ingested_at"
    )
    value = F.try_element_at("constraints", "constraint_name")
    keyed = t.join(F.broadcast(plans), "domain").select(
        "plan_id", "task_id", "ingested_at", F.when(value.isNull(), F.lit(ABSENT)).otherwise(category_key(value)).alias("key"), value.isNull().alias("absent")
    )
    # A value that reads "(absent)" is no missing key.
    found = keyed.join(F.broadcast(wanted), ["plan_id", "key"]).where((F.col("key") != ABSENT) | F.col("absent"))
    per = found.groupBy("plan_id", "task_id").agg(F.max(F.struct("ingested_at", "category")).alias("last"), F.collect_set("category").alias("named"))
    each = per.select("plan_id", "task_id", F.col("last.category").alias("mine"), F.explode("named").alias("category"))
    return each.select("plan_id", "category", "task_id", (F.col("mine") == F.col("category")).alias("own"))


def available(candidates: DataFrame) -> DataFrame:
    """Distinct tasks by (plan_id, category), and how many of them the category can draw."""
    return candidates.groupBy("plan_id", "category").agg(F.count(F.lit(1)).alias("available"), F.count_if("own").alias("capacity"))


def default_path(category: str) -> tuple[str, ...]:
    """Absent or stated / family / category. A family is what stands before the first number (versions of one system, say).

    Versions make up for each other first, then other stated values do, then the absent ones.
    """
    if category == ABSENT:
        return "absent", category
    return "stated", re.split(r"\s*\d", category.strip().lower(), maxsplit=1)[0], category


def allocation(tasks: DataFrame, targets: DataFrame, *, path=default_path, max_targets: int = 100_000, candidates: DataFrame | None = None) -> DataFrame:
    """Per (plan_id, category): target_share, min_tasks, sample_size, available, capacity, quota, own_target, buckets, below_min, below_target.

    ``own_target`` is the whole number of tasks the category needs by its share and minimum, ``quota`` what
    the tree allots to it. ``targets`` is a control table of one row per category; more than
    ``max_targets`` rows are an error. Categories no task belongs to have 0 available. Repeated target
    rows count once.
    """
    spark = tasks.sparkSession
    wanted = targets.select("plan_id", "category", "target_share", "min_tasks", "sample_size").dropDuplicates(["plan_id", "category"])
    have = available(plan_candidates(tasks, targets, max_targets) if candidates is None else candidates)
    rows = small(wanted.join(have, ["plan_id", "category"], "left"), max_targets, "targets")
    plans = defaultdict(list)
    for r in rows:
        plans[r.plan_id].append(r)
    out = []
    for plan, rs in plans.items():
        leaves = [(path(r.category), float(r.target_share or 0.0), int(r.min_tasks or 0), int(r.capacity or 0)) for r in rs]
        quotas = allocate(max(int(r.sample_size or 0) for r in rs), leaves)
        for r in rs:
            have, share, size, least = int(r.available or 0), float(r.target_share or 0.0), int(r.sample_size or 0), int(r.min_tasks or 0)
            own = max(least, math.ceil(share * size), 0)
            out.append(
                (plan, r.category, share, least, size, have, int(r.capacity or 0), quotas[path(r.category)], own, max(1, -(-have // BUCKET_ROWS)), have < least, have < share * size)
            )
    return spark.createDataFrame(
        out,
        "plan_id string, category string, target_share double, min_tasks long, sample_size long, available long, capacity long, quota long, "
        "own_target long, buckets long, below_min boolean, below_target boolean",
    )


def ranked(candidates: DataFrame, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """(plan_id, category, task_id, own, rank) of all tasks a category draws for its own target or its quota.

    Ranks are dense, from 1, in the order of a hash of the id; tasks that another category draws come
    last. Only buckets that begin before the further of both ends are ranked, each by a sort of its own.
    """
    wanted = F.broadcast(quotas.select("plan_id", "category", "quota", "buckets", F.greatest("own_target", "quota").alias("last")))  # allocation bounds it
    h = F.xxhash64(F.lit(seed), F.col("task_id"))
    bucket = F.shiftright(F.shiftrightunsigned("h", 33) * F.col("buckets"), 31) + F.when(F.col("own"), 0).otherwise(F.col("buckets"))
    rows = candidates.withColumn("h", h).join(wanted, ["plan_id", "category"]).withColumn("bucket", bucket)
    w = Window.partitionBy("plan_id", "category").orderBy("bucket")
    counts = rows.groupBy("plan_id", "category", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"))
    before = counts.select("plan_id", "category", "bucket", "last", (F.sum("n").over(w) - F.col("n")).alias("before")).where("before < last")
    placed = rows.drop("last").join(before, ["plan_id", "category", "bucket"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("plan_id", "category", "bucket").orderBy("h", "task_id"))
    return placed.withColumn("rank", rank).where("rank <= last").select("plan_id", "category", "task_id", "own", "rank")


def draw(candidates: DataFrame, quotas: DataFrame, seed: int = 0, *, ranks: DataFrame | None = None) -> DataFrame:
    """(plan_id, category, task_id, rank): the first ``quota`` tasks of each category; of ``ranks`` where they are known."""
    ranks = ranked(candidates, quotas, seed) if ranks is None else ranks
    return ranks.join(F.broadcast(quotas.select("plan_id", "category", "quota")), ["plan_id", "category"]).where("rank <= quota").select("plan_id", "category", "task_id", "rank")


def unmet(quotas: DataFrame, ranks: DataFrame) -> DataFrame:
    """(plan_id, category, own_target, reached) of the categories whose draw to their own target ended before it."""
    keys = ["plan_id", "category"]
    wanted = quotas.select(*keys, "own_target")
    reached = ranks.join(F.broadcast(wanted), keys).where("rank <= own_target").groupBy(*keys).agg(F.count(F.lit(1)).alias("reached"))
    got = F.coalesce("reached", F.lit(0))
    return wanted.join(reached, keys, "left").select(*keys, "own_target", got.alias("reached")).where("reached < own_target")


def report(quotas: DataFrame, drawn: DataFrame) -> DataFrame:
    """The allocation with what was drawn: drawn, actual_share (of the plan's draw) and shortfall against the target."""
    n = drawn.groupBy("plan_id", "category").agg(F.count(F.lit(1)).alias("drawn"))
    w = Window.partitionBy("plan_id")
    got = F.coalesce("drawn", F.lit(0))
    return quotas.join(n, ["plan_id", "category"], "left").select(
        *quotas.columns,
        got.alias("drawn"),
        (got / F.nullif(F.sum(got).over(w), F.lit(0))).alias("actual_share"),
        F.greatest(F.ceil(F.col("target_share") * F.col("sample_size")) - got, F.col("min_tasks") - got, F.lit(0)).cast("long").alias("shortfall"),
    )
