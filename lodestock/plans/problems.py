"""Queries p3 and p4: the column quality profile of laptops, and fields that hold several values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.operators.packed import split_packed
from lodestock.operators.quality_profile import drift_reasons, quality_profile, quality_tags
from lodestock.sources.tables import table

NOT_PROFILED = ("listing_id", "loaded_at", "ports")
PACKED = (("laptops", "listing_id", "use_cases"), ("cars", "car_id", "market_category"), ("games", "game_id", "supported_platforms"))


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return quality_profile(table(spark, folder, "laptops"), table(spark, folder, "loads"), skip=NOT_PROFILED)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(load_id, column_name) that changed against the load's baseline."""
    return drift_reasons(_profile(spark, folder)).where(F.size("reasons") > 0).select("load_id", "column_name")


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The whole profile of every column of laptops and each load."""
    return quality_tags(drift_reasons(_profile(spark, folder)))


def vocabulary(spark: SparkSession, folder: str, domain: str, name: str) -> list[str]:
    row = table(spark, folder, "attribute_specs").where((F.col("domain") == domain) & (F.col("name") == name)).select("vocabulary").first()
    return list(row[0] or []) if row else []


def _packed(spark: SparkSession, folder: str, min_values: int) -> DataFrame:
    parts = [
        split_packed(table(spark, folder, name), key, cell, vocabulary(spark, folder, name, cell), min_values=min_values).withColumn(
            "table_name", F.lit(name)
        )
        for name, key, cell in PACKED
    ]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per label of every cell that holds two or more."""
    return _packed(spark, folder, 2).select("table_name", F.col("row_id").cast("long"), "pos", "value")


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values with the error flags of their cell."""
    return _packed(spark, folder, 1).select("table_name", "row_id", "pos", "value", "n_values", F.array_join("flags", ",").alias("flags"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, values, distinct values and the median of every column of laptops and each load."""
    p = _profile(spark, folder)
    return p.select("load_id", "column_name", "rows", "n", "n_distinct", F.when(F.col("kind") == "number", F.round("median", 6)).alias("median"))


QUERIES = {"p3_counts": p3_counts, "p3_found": p3_found, "p3_profile": p3_profile, "p4_found": p4_found, "p4_values": p4_values}


def _drift_sql() -> str:
    numbers = "price ram_gb storage_gb screen_inches refresh_rate_hz weight_kg battery_hours avg_rating num_reviews".split()
    strings = "product_id name brand processor storage_type display_type gpu_type webcam_resolution os_version use_cases description".split()
    flags = "touchscreen backlit_keyboard numeric_keypad".split()
    found = []
    pair = "from laptops x join loads l on l.load_id = x.load_id where l.baseline_load_id is not null"
    both = f"select l.load_id, 'a' side, x.* exclude (load_id) {pair} union all select l.load_id, 'b', x.* exclude (load_id) from laptops x join loads l on l.baseline_load_id = x.load_id"
    for c in [*numbers, *strings, *flags, "scraped_at"]:
        v = f"case when isnan({c}) then null else {c} end" if c in ("price", "screen_inches", "weight_kg", "battery_hours", "avg_rating") else c
        t = f"(select load_id, side, {v} v from pairs)"
        found.append(f"""select load_id, '{c}' column_name from (select load_id,
            1 - count(v) filter (side = 'a') / count(*) filter (side = 'a')::double - 1 + count(v) filter (side = 'b') / count(*) filter (side = 'b')::double d
            from {t} group by 1) where abs(d) > 0.15""")
        if c in numbers:
            found.append(f"""select load_id, '{c}' from (select load_id, median(v::double) filter (side = 'a') a, median(v::double) filter (side = 'b') b
                from {t} group by 1) where abs(a - b) > 0.25 * abs(b)""")
            found.append(f"""select load_id, '{c}' from (select t.load_id, count(*) filter (v < lo or v > hi) o, count(v) n
                from {t} t join (select load_id, min(v) lo, max(v) hi from {t} where side = 'b' group by 1) r on r.load_id = t.load_id
                where side = 'a' group by 1) where o > 0.10 * n""")
        elif c in strings:
            found.append(f"""select load_id, '{c}' from (select load_id,
                count(distinct v) filter (side = 'a') / nullif(count(v) filter (side = 'a'), 0)::double - count(distinct v) filter (side = 'b') / nullif(count(v) filter (side = 'b'), 0)::double d
                from {t} group by 1) where abs(d) > 0.25""")
            form = "regexp_replace(regexp_replace(v, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '9', 'g')"
            found.append(f"""select load_id, '{c}' from (select f.load_id, f.form, n / sum(n) over (partition by f.load_id) share, row_number() over (partition by f.load_id order by n desc, form) k
                from (select load_id, {form} form, count(*)::double n from {t} where side = 'b' and v is not null group by 1, 2) f) top
                join (select load_id l, {form} form_a, count(*)::double m from {t} where side = 'a' and v is not null group by 1, 2) a on a.l = load_id
                where k = 1 group by load_id, share, form having share - sum(case when form_a = form then m else 0 end) / sum(m) > 0.3""")
        if c in strings + flags:
            few = "true" if c in flags else "da <= 20 and db <= 20"
            found.append(f"""select load_id, '{c}' from (select load_id, sum(abs(a / na - b / nb)) / 2 d, count(*) filter (a > 0) da, count(*) filter (b > 0) db from
                (select load_id, v, a, b, sum(a) over (partition by load_id) na, sum(b) over (partition by load_id) nb from
                (select load_id, v, count(*) filter (side = 'a')::double a, count(*) filter (side = 'b')::double b from {t} where v is not null group by 1, 2))
                where na > 0 and nb > 0 group by 1) where d > 0.3 and {few}""")
    return f"with pairs as ({both}) select distinct load_id, column_name from (" + " union all ".join(found) + ")"


def _counts_sql() -> str:
    numbers = "price ram_gb storage_gb screen_inches refresh_rate_hz weight_kg battery_hours avg_rating num_reviews".split()
    others = "product_id name brand processor storage_type display_type gpu_type webcam_resolution os_version use_cases description touchscreen backlit_keyboard numeric_keypad scraped_at".split()
    one = []
    for c in [*numbers, *others]:
        v = f"case when isnan({c}) then null else {c} end" if c in ("price", "screen_inches", "weight_kg", "battery_hours", "avg_rating") else c
        median = f"round(median(({v})::double), 6)" if c in numbers else "null::double"
        one.append(f"select load_id, '{c}' column_name, count(*) as rows, count({v}) n, count(distinct {v}) n_distinct, {median} as median from laptops where load_id is not null group by 1")
    return " union all ".join(one)


ORACLES = {"p3_found": _drift_sql(), "p3_counts": _counts_sql()}
