"""Assembly and validation of tasks, display lines, and what surrounds a run: side inputs by injected providers."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.model import Domain, Preference, Trigger
from lodestock.operators.scoring import weights

DIRECTIONS = ("minimize", "maximize", "match")
MODES = ("responsive", "contextual")
#: What a user says who was shown something that breaks a constraint, by the kind of operator.
VIOLATION_TEXTS = {
    "lte": "shown an item above the limit", "gte": "shown an item below the minimum", "eq": "shown another value", "in_set": "shown a value outside the set",
    "contains_any": "shown an item without any of them", "contains_all": "shown an item without all of them", "not_contains_any": "shown an item with an unwanted one",
    "boolean": "shown an item without the feature", "range": "shown an item outside the range", "substring": "shown an item that does not mention it",
}


def assemble(anchors: DataFrame, ranked: DataFrame, stats: DataFrame, preferences: list[Preference]) -> DataFrame:
    """One row per task: best products (ties), best utility, weights and pool statistics, rounded to 4 decimals.

    ``ranked`` has task_id, pid, utility, best; ``stats`` the columns of ``pool_stats`` by task_id.
    """
    best = ranked.where("best").groupBy("task_id").agg(F.array_sort(F.collect_set("pid")).alias("best_product_ids"), F.round(F.max("utility"), 4).alias("best_utility"))
    size = ranked.groupBy("task_id").agg(F.count(F.lit(1)).alias("pool_size"))
    numbers = {c: F.round(F.col(c), 4) for c in stats.columns if c != "task_id"}
    w = F.array(*[F.lit(round(x, 4)) for x in weights(len(preferences))]) if preferences else F.array().cast("array<double>")
    return anchors.join(best, "task_id").join(size, "task_id").join(stats.withColumns(numbers), "task_id").withColumn("preference_weights", w)


def preference_problems(preferences: Column) -> Column:
    """array<string>: what is wrong with array<struct<attribute, direction, target, priority, revelation_mode, trigger>>."""
    any_ = lambda test: F.exists(preferences, test)
    names = F.transform(preferences, lambda p: p["attribute"])
    order = F.array_sort(F.transform(preferences, lambda p: p["priority"].cast("long")))
    return F.array_compact(
        F.array(
            F.when(preferences.isNull() | (F.size(preferences) == 0), F.lit("empty")),
            F.when(any_(lambda p: p["attribute"].isNull() | (p["attribute"] == "")), F.lit("no_attribute")),
            F.when(any_(lambda p: ~F.coalesce(p["direction"].isin(*DIRECTIONS), F.lit(False))), F.lit("direction")),
            F.when(any_(lambda p: (p["direction"] == "match") & p["target"].isNull()), F.lit("no_target")),
            F.when(any_(lambda p: ~F.coalesce(p["revelation_mode"].isin(*MODES), F.lit(False))), F.lit("mode")),
            F.when(F.size(F.array_distinct(names)) < F.size(names), F.lit("repeated")),
            F.when((F.size(preferences) > 0) & (order != F.sequence(F.lit(1).cast("long"), F.greatest(F.size(preferences), F.lit(1)).cast("long"))), F.lit("priorities")),
        )
    )


def merged_preferences(own: list[Preference], unused: list[Preference], triggers: list[Trigger]) -> list[Preference]:
    """Preferences with those made from unused constraints behind them, priorities counted on, triggers looked up (first wins)."""
    out = sorted(own, key=lambda p: p.priority)
    for p in unused:
        trigger = next((t.name for t in triggers if p.attribute in t.keys), p.trigger)
        out.append(Preference(p.attribute, p.direction, p.target, len(out) + 1, p.revelation_mode, trigger))
    return out


def forbidden_terms(constraints: Column, least: int = 3) -> Column:
    """Words of constraint values that an opening query must not give away: no flags, no numbers, three characters or more."""
    low = F.transform(F.map_values(constraints), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(low, lambda v: v.isNotNull() & (F.length(v) >= least) & ~v.isin("true", "false", "none", "null") & v.try_cast("double").isNull()))


def violation_triggers(domain: Domain) -> list[tuple[str, str, str]]:
    """(trigger, constraint, description) of every structured constraint."""
    return [(f"shown_wrong_{c.name}", c.name, VIOLATION_TEXTS.get(c.operator, "shown an item that breaks it")) for c in domain.constraints if not c.desc_constraint]


def preference_label(attribute: Column, direction: Column, target: Column) -> Column:
    """``lower price``, ``higher rating``, ``brand = x`` as text."""
    shown = F.replace(attribute, F.lit("_"), F.lit(" "))
    return F.when(direction == "minimize", F.concat(F.lit("lower "), shown)).when(direction == "maximize", F.concat(F.lit("higher "), shown)).otherwise(F.concat(shown, F.lit(" = "), target))


def one_line(parts: dict[str, Column]) -> Column:
    """A product in one line: ``label: value`` parts that have a value, with bars between."""
    return F.concat_ws(" | ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}: " if k else ""), c.cast("string"))) for k, c in parts.items()])


def duration(minutes: Column) -> Column:
    """Minutes as ``2.5 h`` (rounded half-up in whole minutes) or ``40 min``."""
    hours = F.floor((minutes + 3) / 6) / 10.0
    return F.when(minutes >= 60, F.concat(F.format_number(hours, 1), F.lit(" h"))).when(minutes.isNotNull(), F.concat(minutes.cast("long").cast("string"), F.lit(" min")))


def day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def recoded(value: Column, words: dict[str, str]) -> Column:
    """Values put into the given words, others as they are."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), value)


def filled(template: str, values: dict[str, str]) -> str:
    """A template with the known names in braces put in, and all else left alone."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def column_context(df: DataFrame, samples: int = 2) -> DataFrame:
    """(column_name, dtype, filled, examples): share of non-null cells and the least values of each column."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        shown = F.to_json(c) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else c.cast("string")
        cells.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.avg(c.isNotNull().cast("double")).alias("filled"), F.min(shown).alias("a"), F.max(shown).alias("b")))
    out = df.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    return out.select("column_name", "dtype", "filled", F.slice(F.array_distinct(F.array_compact(F.array("a", "b"))), 1, samples).alias("examples"))


def embedded(df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], key: str, batch: int = 512) -> DataFrame:
    """(key, embedding) by an injected provider, in batches inside the tasks; null and empty texts get the empty vector."""
    dtype = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = [t or "" for t in part["text"]]
                wanted = [t for t in texts if t]
                found = iter(provider(wanted) if wanted else [])
                yield pd.DataFrame({"key": part["key"], "embedding": [next(found) if t else [] for t in texts]})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {dtype}, embedding array<float>").withColumnRenamed("key", key)


def manifest(folder: str) -> dict:
    """Manifest of a domain folder: name and id are needed; alias and tables have defaults."""
    path = Path(folder, "manifest.json")
    data = json.loads(path.read_text()) if path.exists() else {}
    if missing := [k for k in ("name", "id_column") if not data.get(k)]:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    name = str(data["name"])
    return {"alias": name.lower().replace(" ", "_"), "catalog": "catalog.parquet", "tasks": "tasks.json"} | data


class CallLog:
    """Calls of a provider as JSON lines, one writer at a time."""

    def __init__(self, path: str | None):
        self.path, self._lock = path, threading.Lock()

    def __call__(self, provider: Callable) -> Callable:
        def logged(*args, **kwargs):
            began = time.time()
            out = provider(*args, **kwargs)
            if self.path:
                with self._lock, open(self.path, "a") as f:
                    f.write(json.dumps({"seconds": round(time.time() - began, 3), "args": repr(args)[:200]}) + "\n")
            return out

        return logged


def parsed_json(provider: Callable[[str], str], prompt: str, tries: int = 3) -> object:
    """A provider's answer as JSON, without code fences, asked again while it is none."""
    for left in reversed(range(tries)):
        text = provider(prompt).strip()
        if text.startswith("```"):
            text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
        try:
            return json.loads(text)
        except ValueError:
            if not left:
                raise
    return None
