"""The constraint algebra: 15 operators, each as a filter predicate and as a two-valued mask.

``condition`` is for WHERE: bare three-valued predicates that Catalyst can push to the scan (a null
drops the row anyway). ``mask`` is for counting, negating and per-row reports: it is never null. Both
select the same rows. Null keeps a row only where the operator says so: ``neq``, ``boolean`` with a
false target, ``substring`` and ``eq`` of "", and set operators without targets.
"""

from __future__ import annotations

import warnings
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.model import ConstraintSpec

#: Words that stand for a missing value, and for true.
SENTINELS = ("NA", "N/A", "NAN")
TRUE_WORDS = ("true", "1", "yes")

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def targets(value: Any) -> list[str]:
    """The target values in lower case: a scalar is one target, whatever its length."""
    if value is None:
        return []
    many = list(value) if isinstance(value, list | tuple | set | frozenset) else [value]
    return [str(v).lower() for v in many if v is not None]


def truth(value: Any) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in TRUE_WORDS


def number(c: Column, dtype: T.DataType) -> Column:
    """The column as a double without NaN; text that is no number is null."""
    if isinstance(dtype, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double") if isinstance(dtype, NUMERIC) else c.cast("string").try_cast("double")


def bound(value: Any) -> float | datetime | None:
    """A bound as a number, or None where it is none."""
    try:
        out = float(value)
    except (TypeError, ValueError):
        return None
    return out if out == out else None


def instant(value: Any) -> datetime | None:
    """A bound of a date column: a date or time (UTC if it names no zone), or epoch seconds."""
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    if (seconds := bound(value)) is not None and not isinstance(value, str):
        return datetime.fromtimestamp(seconds, UTC)
    try:
        found = datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def _lower(c: Column) -> Column:
    return F.lower(c.cast("string"))


def _compare(c: Column, dtype: T.DataType, value: Any, op: str) -> Column:
    """c <op> value for lte and gte; null (or false) where it can't hold."""
    if isinstance(dtype, TEMPORAL):
        at = instant(value)
        if at is None:
            return F.lit(False)
        at = F.lit(at)
        if isinstance(dtype, T.TimestampNTZType):  # stored as UTC; the bare column stays comparable in the scan
            at = at.cast("timestamp_ntz")
        return c <= at if op == "lte" else c >= at
    limit = bound(value)
    if limit is None:
        return F.lit(False)
    if isinstance(dtype, T.FloatType | T.DoubleType):
        # NaN is above every number, so only >= needs the second test.
        return c <= F.lit(limit) if op == "lte" else (c >= F.lit(limit)) & ~F.isnan(c)
    if isinstance(dtype, NUMERIC):
        whole = int(limit) if limit == int(limit) and abs(limit) < 2**53 else limit
        return c <= F.lit(whole) if op == "lte" else c >= F.lit(whole)
    x = number(c, dtype)
    return x <= F.lit(limit) if op == "lte" else (x >= F.lit(limit)) & ~F.isnan(x)


def _elements(c: Column, dtype: T.DataType) -> Column | None:
    """The lower-cased elements of a list column; None for columns that hold no lists."""
    return F.transform(c, lambda x: F.lower(x.cast("string"))) if isinstance(dtype, T.ArrayType) else None


def _raw(c: Column, dtype: T.DataType, op: str, value: Any) -> tuple[Column, bool]:
    """(predicate, whether a null of it keeps the row)."""
    if op in ("lte", "gte"):
        return _compare(c, dtype, value, op), False
    if op == "range":
        lo, hi = value
        if isinstance(dtype, TEMPORAL):
            return F.lit(False), False  # ranges are for numbers only
        return _compare(c, dtype, lo, "gte") & _compare(c, dtype, hi, "lte"), False
    if op == "eq":
        want = str(value).lower()
        return _lower(c) == want, want == ""
    if op == "neq":
        want = str(value).lower()
        return _lower(c) != want, want != ""
    if op in ("in_set", "eq_any"):
        want = targets(value)
        return (_lower(c).isin(want) if want else F.lit(False)), "" in want
    if op == "substring":
        want = str(value).lower()
        return (F.contains(_lower(c), F.lit(want)), False) if want else (F.lit(True), True)
    if op == "boolean":
        want = truth(value)
        flag = c if isinstance(dtype, T.BooleanType) else _lower(c).isin(*TRUE_WORDS)
        return (flag, False) if want else (~flag, True)
    want = [str(value).lower()] if op in ("contains", "not_contains") else targets(value)
    if not want:
        return F.lit(True), True
    items = _elements(c, dtype)
    if items is None:
        return F.lit(False), False
    wanted = F.array(*[F.lit(t) for t in sorted(set(want))])
    # Null elements make arrays_overlap three-valued; array_compact keeps it two-valued for non-null lists.
    if op in ("contains_all", "not_contains_all"):
        has = F.size(F.array_except(wanted, items)) == 0
        has = F.when(c.isNotNull(), has)
    else:
        has = F.arrays_overlap(F.array_compact(items), wanted)
    return (~has if op.startswith("not_") else has), False


def condition(c: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    """The predicate for a WHERE clause."""
    p, keeps = _raw(c, dtype, op, value)
    return c.isNull() | p if keeps else p


def mask(c: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    """The predicate as true or false."""
    p, keeps = _raw(c, dtype, op, value)
    return F.coalesce(p, F.lit(keeps))


def _known(df: DataFrame, constraints: dict[str, Any], registry: list[ConstraintSpec]) -> list[tuple[ConstraintSpec, Any]]:
    by_name = {s.name: s for s in registry}
    out = []
    for name, value in constraints.items():
        spec = by_name.get(name)
        if spec is None or spec.attribute not in df.columns:
            warnings.warn(f"constraint {name!r} is skipped: no such constraint or column", stacklevel=3)
            continue
        out.append((spec, value))
    return out


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def constraint_filter(df: DataFrame, constraints: dict[str, Any], registry: list[ConstraintSpec], *, strict_nulls: bool = False) -> DataFrame:
    """Rows that satisfy all constraints; unknown names and missing columns are skipped with a warning.

    ``strict_nulls`` drops rows with a null in any constrained column, also where an operator would keep them.
    """
    for spec, value in _known(df, constraints, registry):
        c, dtype = _col(spec.attribute), df.schema[spec.attribute].dataType
        df = df.where(condition(c, dtype, spec.operator, value))
        if strict_nulls:
            df = df.where(c.isNotNull())
    return df


def conjunction(df: DataFrame, constraints: dict[str, Any], registry: list[ConstraintSpec]) -> Column:
    """All constraints as one mask."""
    masks = [mask(_col(s.attribute), df.schema[s.attribute].dataType, s.operator, v) for s, v in _known(df, constraints, registry)]
    return reduce(lambda a, b: a & b, masks, F.lit(True))


def missing(c: Column, dtype: T.DataType) -> Column:
    """Whether a value counts as missing for hard constraints: null, NaN, a sentinel word, an empty list."""
    out = c.isNull()
    if isinstance(dtype, T.FloatType | T.DoubleType):
        out = out | F.isnan(c)
    elif isinstance(dtype, T.StringType):
        out = out | F.upper(F.trim(c)).isin(*SENTINELS)
    elif isinstance(dtype, T.ArrayType):
        out = out | F.forall(c, lambda x: x.isNull())
    return F.coalesce(out, F.lit(True))


def violations(df: DataFrame, constraints: dict[str, Any], registry: list[ConstraintSpec]) -> Column:
    """array<string>: what each row violates, in the order of the constraints; empty if nothing.

    Stricter than ``constraint_filter``: a missing value violates whatever the operator.
    """
    out = []
    for spec, value in _known(df, constraints, registry):
        c, dtype = _col(spec.attribute), df.schema[spec.attribute].dataType
        shown = F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]")) if isinstance(dtype, T.ArrayType) else c.cast("string")
        out.append(
            F.when(missing(c, dtype), F.lit(f"{spec.attribute} is missing or NA (cannot satisfy constraint '{spec.name}')")).when(
                ~mask(c, dtype, spec.operator, value), F.concat(F.lit(f"{spec.attribute}="), shown, F.lit(f" violates {spec.label(value)}"))
            )
        )
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def lookup(df: DataFrame, id_column: str, value: Any) -> DataFrame:
    """The row with an id, given in any type that casts to the column's."""
    return df.where(_col(id_column) == F.lit(str(value)).try_cast(df.schema[id_column].dataType))


def row_coverage(df: DataFrame, columns: list[str], garbage: tuple[str, ...] = (), threshold: float = 0.6) -> DataFrame:
    """Rows with at least ``threshold`` of the columns present; a list is present with one element that is no garbage."""
    known = [c for c in columns if c in df.columns]
    if not known:
        return df
    bad = [g.lower() for g in garbage]

    def present(name: str) -> Column:
        c, dtype = _col(name), df.schema[name].dataType
        if isinstance(dtype, T.ArrayType):
            return F.coalesce(F.exists(c, lambda x: x.isNotNull() & ~F.lower(F.trim(x.cast("string"))).isin(*bad, "")), F.lit(False))
        if isinstance(dtype, T.StringType):
            return F.coalesce(~F.lower(F.trim(c)).isin(*bad, ""), F.lit(False))
        return ~missing(c, dtype)

    held = reduce(lambda a, b: a + b, [present(c).cast("int") for c in known])
    return df.where(held >= F.lit(threshold * len(known)))


def described(value: Column, required: Column) -> Column:
    """Whether a described value meets a requirement: flags and texts must be equal, numbers at least as large."""
    v, r = F.lower(F.trim(value)), F.lower(F.trim(required))
    a, b = v.try_cast("double"), r.try_cast("double")
    return F.coalesce(F.when(r.isin("true", "false"), v == r).when(a.isNotNull() & b.isNotNull(), a >= b).otherwise(v == r), F.lit(False))


def description_filter(pool: DataFrame, described_values: DataFrame, wanted: dict[str, Any], key: str) -> DataFrame:
    """Rows of the pool whose description has all wanted attributes; described_values is (key, attr, value)."""
    for attr, value in wanted.items():
        hits = described_values.where((F.col("attr") == attr) & described(F.col("value"), F.lit(str(value))))
        pool = pool.join(hits.select(F.col("pid").alias(key)), key, "left_semi")
    return pool


def query_problems(query: Column, forbidden: list[str]) -> Column:
    """array<string>: what is wrong with a task's opening query: numbers, forbidden terms, length out of 3 to 15 words."""
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: F.length(w) > 0))
    low = F.lower(query)
    terms = [t.lower() for t in forbidden if len(t) >= 3]
    leaked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms], F.lit(False))
    return F.array_compact(
        F.array(
            F.when(query.isNull() | (F.trim(query) == ""), F.lit("empty")),
            F.when(query.rlike(r"[$€£]?\d"), F.lit("number")),
            F.when(leaked, F.lit("leaked_term")),
            F.when((words < 3) | (words > 15), F.lit("length")),
        )
    )


def plan_problems(keys: Column, assigned: Column) -> Column:
    """Constraint keys that a revelation plan leaves out."""
    return F.array_sort(F.array_except(keys, assigned))
