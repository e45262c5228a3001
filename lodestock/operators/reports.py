"""What is shown of results: lines for a simulated user, tables as text, profiles as text, rules read from a file."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestock.operators.profile import ColumnProfile, noise
from lodestock.sources.shared import small

#: Tiers in the order reports show them; others follow by name.
TIERS = ("overall", "easy", "small", "medium", "large", "hard", "expert", "oc_feasible", "oc_infeasible")


def constraint_lines(constraints: Column, modes: Column, triggers: Column | None = None) -> Column:
    """array<string>: ``- key: value  [mode]`` for each entry of a map, by key; ``[mode: trigger]`` where a trigger is known.

    ``modes`` and ``triggers`` are maps by key; a key without a mode is told when asked (responsive).
    """
    keys = F.array_sort(F.map_keys(constraints))
    none = F.create_map().cast("map<string,string>")
    mode, trigger = F.coalesce(modes, none), F.coalesce(triggers, none) if triggers is not None else none

    def line(k: Column) -> Column:
        how = F.coalesce(F.try_element_at(mode, k), F.lit("responsive"))
        tag = F.concat_ws(": ", how, F.try_element_at(trigger, k))
        return F.concat(F.lit("- "), k, F.lit(": "), F.coalesce(F.element_at(constraints, k), F.lit("")), F.lit("  ["), tag, F.lit("]"))

    return F.coalesce(F.transform(keys, line), F.array().cast("array<string>"))


def share(value: Column, digits: int = 1) -> Column:
    """0.821 as ``82.1%``; null as a dash."""
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit("%")), F.lit("-"))


def mean_and_spread(mean: Column, std: Column, digits: int = 1) -> Column:
    """``82.1% ± 3.0%``, without the spread where there is none."""
    return F.when(std > 0, F.concat(share(mean, digits), F.lit(" ± "), share(std, digits))).otherwise(share(mean, digits))


def ranking_table(results: DataFrame, metrics: list[str], tier: str = "difficulty") -> DataFrame:
    """(difficulty, n, each metric's mean) over all tasks (``overall``) and by tier; absent metrics are left out of the mean."""
    named = results.withColumn(tier, F.coalesce(tier, F.lit("(none)")))
    out = named.rollup(tier).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return out.withColumn(tier, F.coalesce(tier, F.lit("overall")))


def with_errors(tasks: DataFrame, results: DataFrame, task: str = "task_id") -> DataFrame:
    """A row for every task: those without a result have their columns null and ``error`` set, so that none is lost from a mean."""
    marked = results.withColumn("_done", F.lit(True))
    out = tasks.select(task).distinct().join(marked, task, "left")
    return out.withColumn("error", F.when(F.col("_done").isNull(), F.lit("no result"))).drop("_done")


def as_text(df: DataFrame, title: str = "", max_rows: int = 1000) -> str:
    """A small table as aligned text, tiers in their order; more than ``max_rows`` rows are an error."""
    rows = [[("-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in small(df, max_rows, "report")]
    place = {t: i for i, t in enumerate(TIERS)}
    rows.sort(key=lambda r: (place.get(r[0], len(TIERS)), r))
    width = [max(len(x) for x in column) for column in zip(df.columns, *rows)]
    shape = lambda r: "  ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(r, width)))
    lines = [title] if title else []
    return "\n".join([*lines, shape(df.columns), "  ".join("-" * w for w in width), *map(shape, rows)])


def profile_text(profiles: list[ColumnProfile]) -> str:
    """Profiles as text, one line a column: kind, nulls, distinct values, tags, siblings, and why it is noise."""
    out = []
    for p in sorted(profiles, key=lambda p: p.name):
        parts = [p.kind, f"{p.null_rate:.1%} null", f"{p.n_unique:,} distinct", *([f"tags {', '.join(p.tags)}"] if p.tags else [])]
        if p.details.get("siblings"):
            parts.append(f"beside {', '.join(p.details['siblings'])}")
        if why := noise(p):
            parts.append(f"noise: {why}")
        out.append(f"{p.name}: " + "; ".join(parts))
    return "\n".join(out)


def batches(items: list, size: int) -> list[list]:
    """Runs of at most ``size`` items, in order: what a provider is asked at once."""
    return [items[i : i + size] for i in range(0, len(items), size)]


def kept_columns(answer: Any) -> dict[str, str]:
    """Column -> reason of a provider's answer: a list of names, or of objects with ``column`` and ``reason``; the rest is ignored."""
    out: dict[str, str] = {}
    for item in answer if isinstance(answer, list) else []:
        name, why = (item, "") if isinstance(item, str) else (item.get("column"), item.get("reason")) if isinstance(item, dict) else (None, None)
        if isinstance(name, str) and name.strip():
            out[name.strip()] = (why or "").strip() or out.get(name.strip(), "")
    return out


_TESTS: dict[str, Callable[[Any, Any], bool]] = {
    "eq": lambda a, b: str(a).lower() == str(b).lower(), "lte": lambda a, b: float(a) <= float(b), "gte": lambda a, b: float(a) >= float(b), "in": lambda a, b: str(a).lower() in {str(x).lower() for x in b},
}


def declared_rules(rules: Iterable[dict]) -> list[Callable[[dict], bool]]:
    """Coherence rules from data: ``{"never": [{"name", "op", "value"}, ...]}`` forbids sets in which all of its tests hold.

    A test on a constraint that isn't in the set, or that can't be compared, doesn't hold. Feed them to ``configgen.coherent``.
    """

    def holds(test: dict, constraints: dict) -> bool:
        if test["name"] not in constraints:
            return False
        try:
            return _TESTS[test["op"]](constraints[test["name"]], test["value"])
        except (TypeError, ValueError):
            return False

    def rule(tests: list[dict]) -> Callable[[dict], bool]:
        unknown = sorted({t["op"] for t in tests} - set(_TESTS))
        if unknown or not tests:
            raise ValueError(f"a rule needs tests with known operators, not {', '.join(unknown) or 'none'}")
        return lambda constraints: not all(holds(t, constraints) for t in tests)

    return [rule(r["never"]) for r in rules]


def stage_setting(stage: str, chosen: dict[str, str] | str | None, default: str) -> str:
    """The provider of a stage: its own, else the one for all (``*`` or a bare name), else the default."""
    if isinstance(chosen, str):
        return chosen
    return (chosen or {}).get(stage) or (chosen or {}).get("*") or default
