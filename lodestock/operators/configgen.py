"""Derivation of a constraint registry from profiled columns, sampling values, difficulty and revelation plans."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestock.fixed import UNUSABLE_VALUES
from lodestock.functions.text import human
from lodestock.model import AttributeSpec, ConstraintSpec
from lodestock.operators.quantiles import exact_quantiles

#: Attribute type of each inferred kind.
KINDS = {
    "int_numeric": "numeric", "float_numeric": "numeric", "datetime": "numeric", "bool": "boolean",
    "list_of_values": "set_valued", "string_categorical": "categorical", "string_long_text": "text",
}


def covering_values(freq: DataFrame, target: float = 0.90, least: int = 3, tail: float = 0.002, most: int = 50) -> DataFrame:
    """(value, n, share, place): values by share until ``target`` is covered; at least ``least``, at most ``most``, no tail below ``tail``.

    The stop condition is monotone in the order, so the walk is a filter; only ``most`` rows are ordered.
    """
    top = freq.orderBy(F.col("share").desc(), "value").limit(most)
    w = Window.orderBy(F.col("share").desc(), "value")
    walked = top.withColumns({"place": F.row_number().over(w), "before": F.coalesce(F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    return walked.where((F.col("place") <= least) | ((F.col("before") < target) & (F.col("share") >= tail))).drop("before")


def sampling_points(df: DataFrame, column: Column, points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), precision: int = 0) -> DataFrame:
    """(point): distinct rounded percentiles of a number, in order."""
    q = exact_quantiles(df, {"x": column}, list(points))
    return q.select(F.explode(F.array_sort(F.array_distinct(F.transform("q", lambda x: human(x, precision))))).alias("point"))


def date_points(df: DataFrame, column: Column, points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(point): distinct percentiles of a time as ISO dates (UTC)."""
    seconds = (F.unix_micros(column.cast("timestamp")) / 1e6).cast("double")
    q = exact_quantiles(df, {"x": seconds}, list(points))
    days = F.transform("q", lambda x: F.date_format(F.timestamp_seconds(F.bround(x, 0)), "yyyy-MM-dd"))
    return q.select(F.explode(F.array_sort(F.array_distinct(days))).alias("point"))


def sanitised(values: DataFrame, column: str = "value") -> DataFrame:
    """Text values without garbage; a JSON object stands for its text, value or name."""
    v = F.trim(F.col(column))
    obj = F.try_parse_json(v)
    inner = F.coalesce(*[F.try_variant_get(obj, f"$.{k}", "string") for k in ("text", "value", "name")])
    clean = F.when(F.startswith(v, F.lit("{")) & (F.trim(inner) != ""), F.trim(inner)).otherwise(v)
    return values.withColumn(column, clean).where(F.col(column).isNotNull() & ~F.lower(F.col(column)).isin(*UNUSABLE_VALUES))


def derive_attribute(name: str, kind: str, null_rate: float, role: str, vocabulary: list[str] | None = None) -> AttributeSpec:
    direction = {"minimize": "minimize", "maximize": "maximize"}.get(role)
    return AttributeSpec(
        name, name.replace("_", " ").title(), KINDS.get(kind, "text"), required=null_rate <= 0.01, coverage_threshold=round(1 - null_rate, 4),
        vocabulary=vocabulary, preference_eligible=direction is not None, preference_direction=direction,
    )


def derive_constraints(name: str, kind: str, n_values: int, direction: str | None = None, polarity: str = "include", membership: str = "any", values: list[Any] | None = None) -> list[ConstraintSpec]:
    """Constraints of a column by its kind: bounds for numbers and dates, membership for lists, equality or set for the rest."""
    values = values or []
    shown = name.replace("_", " ")
    if kind in ("int_numeric", "float_numeric", "datetime"):
        out = []
        if direction in ("minimize", None):
            out.append(ConstraintSpec(f"{name}_max", name, "lte", f"{shown} at most {{value}}", "float", values, soft_direction="minimize"))
        if direction in ("maximize", None):
            out.append(ConstraintSpec(f"{name}_min", name, "gte", f"{shown} at least {{value}}", "float", values, soft_direction="maximize"))
        return out
    if kind == "list_of_values":
        op = ("not_contains" if polarity == "exclude" else "contains") + ("_any" if membership == "any" else "_all")
        return [ConstraintSpec(f"{name}_{'excludes' if polarity == 'exclude' else 'includes'}", name, op, f"{shown}: {{value}}", "list[str]", values)]
    if kind == "bool":
        return [ConstraintSpec(name, name, "boolean", f"{shown}: {{value}}", "bool", [True])]
    if kind == "string_categorical":
        op = "eq" if n_values <= 10 else "in_set"
        return [ConstraintSpec(name, name, op, f"{shown}: {{value}}", "str" if op == "eq" else "list[str]", values)]
    return []


def hard_filter_possible(kind: str) -> bool:
    """Kinds that can be constrained at all; free text and nested values can't."""
    return kind in KINDS and kind != "string_long_text"


def promote_preferences(attributes: list[AttributeSpec], least: int = 3) -> list[AttributeSpec]:
    """Makes numeric, then categorical attributes preferences until there are ``least``."""
    have = sum(a.preference_eligible for a in attributes)
    for kind, direction in (("numeric", "maximize"), ("categorical", "match"), ("boolean", "match")):
        for a in attributes:
            if have < least and a.attr_type == kind and not a.preference_eligible:
                a.preference_eligible, a.preference_direction = True, direction
                have += 1
    return attributes


def difficulty(infeasible: Column, pool_size: Column, n_constraints: Column, n_proactive: Column, n_reactive: Column, large_hi: int, large_least: int) -> Column:
    """Tier of a task from its pool and how its constraints are revealed."""
    elicited = F.when(n_constraints > 0, F.lit(1.0) - n_proactive / n_constraints).otherwise(1.0)
    return (
        F.when(F.coalesce(infeasible, F.lit(False)), "oc_infeasible")
        .when(pool_size <= 3, "oc_feasible")
        .when((n_reactive >= 2) & (pool_size <= large_hi) & (n_constraints >= large_least), "large")
        .when((elicited < 0.40) & (n_reactive == 0), "small")
        .otherwise("medium")
    )


def revelation_counts(n: Column, tier: Column) -> tuple[Column, Column, Column]:
    """How many of n constraints are told at once, when asked, and only after a wrong offer."""
    part = lambda share: F.floor(n * F.lit(share)).cast("long")
    first = (
        F.when(tier == "small", F.greatest(F.lit(1), part(0.6) + F.when(n > 1, 1).otherwise(0)))
        .when(tier == "large", F.greatest(F.lit(1), F.least(part(0.25), n - 2)))
        .when(tier.isin("oc_feasible", "oc_infeasible"), F.greatest(F.lit(1), part(0.3)))
        .otherwise(F.greatest(F.lit(1), part(0.4)))
    )
    first = F.when(n == 0, 0).otherwise(first).cast("long")
    late = F.when(tier == "small", 0).when(tier == "large", F.least(F.lit(2), n - first)).otherwise(F.least(F.lit(1), n - first))
    late = F.greatest(F.lit(0), late).cast("long")
    return first, (n - first - late).cast("long"), late


def revelation_plan(constraints: DataFrame, seed: int = 0) -> DataFrame:
    """(task_id, name, mode) of (task_id, name, difficulty): proactive, responsive or reactive, in a permuted order."""
    w = Window.partitionBy("task_id")
    place = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "task_id", "name"), "name"))
    n = F.count(F.lit(1)).over(w)
    first, asked, _ = revelation_counts(n, F.col("difficulty"))
    rows = constraints.withColumns({"_p": place, "_f": first, "_a": asked})
    return rows.select("task_id", "name", F.when(F.col("_p") <= F.col("_f"), "proactive").when(F.col("_p") <= F.col("_f") + F.col("_a"), "responsive").otherwise("reactive").alias("mode"))


def coherent(rules: list[Callable[[dict], bool]]) -> Callable[[dict], bool]:
    """A coherence check that holds if all rules hold; used at plan time, before anything is scanned."""
    return lambda constraints: all(rule(constraints) for rule in rules)


def bounds_agree(low: str, high: str) -> Callable[[dict], bool]:
    """Rule: a lower bound must not exceed the upper one."""
    return lambda c: low not in c or high not in c or float(c[low]) <= float(c[high])
