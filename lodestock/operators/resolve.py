"""Plan-time resolution of what callers type: field names, values of a vocabulary, tool arguments."""

from __future__ import annotations

import difflib
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(text: str) -> str:
    return re.sub(r"^[a-z]{2}:", "", text.strip().lower())


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def fuzzy_value(value: str, vocabulary: list[str], least: float = 0.7) -> str | None:
    """The vocabulary's entry for a value: exact, without prefix, holding or held, else the most alike; None if none is alike."""
    want = _plain(value)
    if not want:
        return None
    tests = (lambda v: v.strip().lower() == value.strip().lower(), lambda v: _plain(v) == want, lambda v: want in _plain(v) or _plain(v) in want)
    for test in tests:
        if hit := next((v for v in vocabulary if v and test(v)), None):
            return hit
    best = max(((ratio(want, _plain(v)), v) for v in vocabulary if v), key=lambda x: x[0], default=(0.0, None))
    return best[1] if best[0] >= least else None


def fuzzy_field(name: str, fields: list[str], aliases: dict[str, str] | None = None, least: float = 0.6) -> str | None:
    """The field meant by a name: exact, by alias, holding or held, else the most alike."""
    key = re.sub(r"[\s-]+", "_", name.strip().lower())
    by_key = {f.lower(): f for f in fields}
    if key in by_key:
        return by_key[key]
    if (alias := (aliases or {}).get(key)) and alias in fields:
        return alias
    if hit := next((f for k, f in by_key.items() if key and (key in k or k in key)), None):
        return hit
    best = max(((ratio(key, k), f) for k, f in by_key.items()), key=lambda x: x[0], default=(0.0, None))
    return best[1] if best[0] >= least else None


def resolve_constraints(constraints: dict[str, Any], vocabularies: dict[str, list[str]]) -> tuple[dict[str, Any], list[str]]:
    """Constraints with values put into the words of their vocabulary, and a note for each change."""
    out, notes = {}, []
    for name, value in constraints.items():
        words = vocabularies.get(name)
        if not words:
            out[name] = value
            continue
        many = value if isinstance(value, list) else [value]
        found = [fuzzy_value(str(v), words) or v for v in many]
        notes += [f"{name}: read {v!r} as {f!r}" for v, f in zip(many, found) if v != f]
        out[name] = found if isinstance(value, list) else found[0]
    return out, notes


def coerce(value: Any, value_type: str) -> Any:
    """An argument as its declared type: float, int, bool, list[str] or str."""
    if value_type == "float":
        return float(value)
    if value_type == "int":
        return int(float(value))
    if value_type == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes")
    if value_type == "list[str]":
        return [str(v) for v in value] if isinstance(value, list | tuple) else [x.strip() for x in str(value).split(",") if x.strip()]
    return str(value)


def similarity(a: Column, b: str) -> Column:
    """Matching-blocks ratio of a text column with a word; no built-in computes it. Use on distinct values."""

    @F.pandas_udf(T.DoubleType())
    def sim(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else ratio(v.lower(), b.lower())).astype("float64")

    return sim(a)
