"""Text, list and display functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words read as true and as false.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two characters or more, in order, repeats kept; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)


def squeeze(text: Column) -> Column:
    """Lower case, trimmed, each run of white space one blank."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def strip_prefix(text: Column) -> Column:
    """Without a two-letter language prefix such as ``en:``."""
    return F.regexp_replace(text, "^[a-z]{2}:", "")


def blob(*parts: Column) -> Column:
    """Texts and lists put together with blanks; nulls are left out."""
    return F.concat_ws(" ", *parts)


def parse_list(text: Column) -> Column:
    """A list written as ``['a', 'b']``, JSON or with commas, as array<string> of trimmed, non-empty items."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    items = F.transform(F.split(inner, r"\s*,\s*"), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return F.filter(items, lambda x: F.length(F.trim(x)) > 0)


def parse_bool(text: Column) -> Column:
    low = F.lower(F.trim(text.cast("string")))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def short_list(items: Column, n: int = 3) -> Column:
    """``a, b, c (+2 more)``; nulls in the list don't count; null for null and empty lists."""
    items = F.array_compact(items)
    head = F.array_join(F.slice(items, 1, n), ", ")
    return F.when(F.size(items) > n, F.concat(head, F.lit(" (+"), (F.size(items) - n).cast("string"), F.lit(" more)"))).when(F.size(items) > 0, head)


def price(value: Column, free: str = "Free to Play") -> Column:
    return F.when(value == 0, F.lit(free)).otherwise(F.concat(F.lit("$"), F.format_number(value, 2)))


def abbreviated(value: Column) -> Column:
    """1234 as 1.2K, 3400000 as 3.4M."""
    v = value.cast("double")
    return (
        F.when(v >= 1e6, F.concat(F.format_number(F.floor(v / 1e5) / 10.0, 1), F.lit("M")))
        .when(v >= 1e3, F.concat(F.format_number(F.floor(v / 1e2) / 10.0, 1), F.lit("K")))
        .otherwise(v.cast("long").cast("string"))
    )


def review_summary(positive: Column, negative: Column) -> Column:
    """``91% positive of 1.2K``; null without reviews."""
    n = F.coalesce(positive, F.lit(0)) + F.coalesce(negative, F.lit(0))
    share = F.floor(F.lit(100.0) * F.coalesce(positive, F.lit(0)) / F.nullif(n, F.lit(0)) + 0.5).cast("long")
    return F.when(n > 0, F.concat(share.cast("string"), F.lit("% positive of "), abbreviated(n)))


def path(*levels: Column) -> Column:
    """``a > b > c`` of the levels that are not null."""
    return F.concat_ws(" > ", *levels)


def label(value: Column, size: int = 200) -> Column:
    """A value as a short canonical label: whole numbers without a fraction, flags as text."""
    text = value.cast("string")
    return F.left(F.when(text.rlike(r"^-?\d+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text), F.lit(size))


def unfence(text: Column) -> Column:
    """The text inside a fenced code block, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*\n(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"^\s+|\s+$", "")


def human(value: Column, precision: int = 0) -> Column:
    """Rounded half-even to the given number of decimals."""
    return F.bround(value.cast("double"), precision)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where a vector is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))
