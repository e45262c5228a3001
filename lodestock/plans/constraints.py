"""Queries of the constraint algebra, over laptops, cars, games and the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestock.functions.text import parse_list
from lodestock.model import ConstraintSpec
from lodestock.operators import predicates as P
from lodestock.plans.common import query
from lodestock.sources.tables import table


def _one(name, table_name, key, column, op, value, sql_condition):
    """A query of one operator: the keys of the rows that a filter keeps and that the mask marks."""

    @query(f"select {key}, true as in_mask from {table_name} where {sql_condition}")
    def run(spark, folder):
        df = table(spark, folder, table_name)
        dtype, c = df.schema[column].dataType, F.col(column)
        return df.where(P.condition(c, dtype, op, value)).select(key, P.mask(c, dtype, op, value).alias("in_mask"))

    from lodestock.plans import common

    run.__name__ = name
    common.QUERIES[name] = common.QUERIES.pop("run")
    common.ORACLES[name] = common.ORACLES.pop("run")


_LIST = "list_transform(genres, lambda x: lower(x))"
_one("f_lte", "laptops", "listing_id", "price", "lte", 600, "price <= 600 and not isnan(price)")
_one("f_gte", "laptops", "listing_id", "price", "gte", 900, "price >= 900 and not isnan(price)")
_one("f_eq", "laptops", "listing_id", "storage_type", "eq", "nvme", "lower(storage_type) = 'nvme'")
_one("f_eq_any", "cars", "car_id", "driven_wheels", "eq_any", ["Front", "REAR"], "lower(driven_wheels) in ('front', 'rear')")
_one("f_neq", "laptops", "listing_id", "os_version", "neq", "Ostra 11", "os_version is null or lower(os_version) <> 'ostra 11'")
_one("f_in_set", "cars", "car_id", "make", "in_set", ["Arvella", "falk", "Korda"], "lower(make) in ('arvella', 'falk', 'korda')")
_one("f_contains", "games", "game_id", "genres", "contains", "Puzzle", f"coalesce(list_contains({_LIST}, 'puzzle'), false)")
_one("f_contains_all", "games", "game_id", "genres", "contains_all", ["racing", "Horror"], f"coalesce(list_has_all({_LIST}, ['racing', 'horror']), false)")
_one("f_contains_any", "games", "game_id", "genres", "contains_any", ["racing", "Horror"], f"coalesce(list_has_any({_LIST}, ['racing', 'horror']), false)")
_one("f_not_contains", "games", "game_id", "genres", "not_contains", "racing", f"genres is not null and not coalesce(list_contains({_LIST}, 'racing'), false)")
_one("f_not_contains_any", "games", "game_id", "genres", "not_contains_any", ["racing", "horror"], f"genres is not null and not coalesce(list_has_any({_LIST}, ['racing', 'horror']), false)")
_one("f_not_contains_all", "games", "game_id", "genres", "not_contains_all", ["racing", "horror"], f"genres is not null and not coalesce(list_has_all({_LIST}, ['racing', 'horror']), false)")
_one("f_substring", "laptops", "listing_id", "description", "substring", "Trackpad", "contains(lower(description), 'trackpad')")
_one("f_boolean", "laptops", "listing_id", "touchscreen", "boolean", True, "touchscreen")
_one("f_boolean_false", "laptops", "listing_id", "touchscreen", "boolean", "no", "touchscreen is null or not touchscreen")
_one("f_range", "cars", "car_id", "msrp", "range", (20000, 45000), "msrp between 20000 and 45000 and not isnan(msrp)")
_one("f_date_gte", "games", "game_id", "release_date", "gte", "2015-01-01", "release_date >= '2015-01-01'::timestamptz")
_one("f_date_epoch", "orders", "o_orderkey", "o_orderdate", "lte", 852076800, "o_orderdate <= '1997-01-01'::timestamp")

REGISTRY = [
    ConstraintSpec("price_max", "price", "lte", "price at most {value}", "float"),
    ConstraintSpec("ram_min", "ram_gb", "gte", "RAM at least {value}", "int"),
    ConstraintSpec("storage", "storage_type", "eq", "storage: {value}"),
    ConstraintSpec("not_os", "os_version", "neq", "not on {value}"),
    ConstraintSpec("ports", "ports", "contains_any", "ports: {value}", "list[str]"),
]
WANTED = {"price_max": 1000, "ram_min": 16, "storage": "ssd", "not_os": "bare", "ports": ["hdmi"]}
_PORTS = "coalesce(list_has_any(list_transform(ports, lambda x: lower(x)), ['hdmi']), false)"


@query(f"""select listing_id from laptops where price <= 1000 and not isnan(price) and ram_gb >= 16 and lower(storage_type) = 'ssd'
  and (os_version is null or lower(os_version) <> 'bare') and {_PORTS}""")
def f_conjunction(spark, folder):
    """Rows that satisfy five constraints."""
    return P.constraint_filter(table(spark, folder, "laptops"), WANTED, REGISTRY).select("listing_id")


@query(f"""select listing_id from laptops where price <= 1000 and not isnan(price) and ram_gb >= 16 and lower(storage_type) = 'ssd' and lower(os_version) <> 'bare' and {_PORTS}""")
def f_conjunction_strict(spark, folder):
    """The same without rows that have a null in a constrained column."""
    return P.constraint_filter(table(spark, folder, "laptops"), WANTED, REGISTRY, strict_nulls=True).select("listing_id")


def _violation(column, name, missing, kept, label, shown=None):
    shown = shown or f"{column}::varchar"
    return f"""case when {missing} then '{column} is missing or NA (cannot satisfy constraint ''{name}'')' when not ({kept}) then '{column}=' || {shown} || ' violates {label}' end"""


_WORD = "coalesce(upper(trim({0})) in ('NA', 'N/A', 'NAN'), true)"


@query(
    "select listing_id, array_to_string(list_filter(["
    + ", ".join(
        [
            _violation("ram_gb", "ram_min", "ram_gb is null", "ram_gb >= 16", "RAM at least 16"),
            _violation("storage_type", "storage", _WORD.format("storage_type"), "lower(storage_type) = 'ssd'", "storage: ssd"),
            _violation("os_version", "not_os", _WORD.format("os_version"), "lower(os_version) <> 'bare'", "not on bare"),
        ]
    )
    + "], lambda x: x is not null), '; ') violations from laptops"
)
def f_violations(spark, folder):
    """What each row violates."""
    df = table(spark, folder, "laptops")
    wanted = {k: WANTED[k] for k in ("ram_min", "storage", "not_os")}
    return df.select("listing_id", F.array_join(P.violations(df, wanted, REGISTRY), "; ").alias("violations"))


@query(
    """select listing_id, coalesce(upper(trim(os_version)) in ('NA', 'N/A', 'NAN'), true) os_missing, price is null or isnan(price) price_missing,
  ports is null or len(list_filter(ports, lambda x: x is not null)) = 0 ports_missing from laptops"""
)
def f_missing(spark, folder):
    """Missing values in the sense of hard constraints."""
    df = table(spark, folder, "laptops")
    return df.select("listing_id", *[P.missing(F.col(c), df.schema[c].dataType).alias(n) for c, n in (("os_version", "os_missing"), ("price", "price_missing"), ("ports", "ports_missing"))])


@query("select p_partkey, p_name, p_brand from part where p_partkey = 42")
def f_point_lookup(spark, folder):
    """One row by its id."""
    return P.lookup(table(spark, folder, "part"), "p_partkey", "42").select("p_partkey", "p_name", "p_brand")


@query(
    """select listing_id from laptops where (price is not null and not isnan(price))::int + (ram_gb is not null)::int
  + (coalesce(lower(trim(gpu_type)) not in ('unknown', 'n/a', ''), false))::int + (battery_hours is not null and not isnan(battery_hours))::int
  + (coalesce(len(list_filter(ports, lambda x: x is not null and lower(trim(x)) not in ('unknown', 'n/a', ''))) > 0, false))::int >= 3"""
)
def f_row_coverage(spark, folder):
    """Rows with at least 60 % of five columns present."""
    return P.row_coverage(table(spark, folder, "laptops"), ["price", "ram_gb", "gpu_type", "battery_hours", "ports"], ("unknown", "n/a")).select("listing_id")


@query(
    """select distinct t.product_id from laptops t where exists (select 1 from laptops d where d.product_id = t.product_id and lower(trim(d.screen_inches::varchar)) is not null and d.screen_inches >= 15
  and not isnan(d.screen_inches)) and exists (select 1 from laptops d where d.product_id = t.product_id and lower(trim(d.display_type)) = 'ips')"""
)
def f_desc_semi(spark, folder):
    """Products whose described attributes meet a requirement: numbers at least, texts equal."""
    laptops = table(spark, folder, "laptops")
    described = laptops.where("not isnan(screen_inches)").select(F.col("product_id").alias("pid"), F.lit("screen").alias("attr"), F.col("screen_inches").cast("string").alias("value")).unionByName(
        laptops.select(F.col("product_id").alias("pid"), F.lit("display").alias("attr"), F.col("display_type").alias("value"))
    )
    return P.description_filter(laptops.select("product_id").distinct(), described, {"screen": 15, "display": "IPS"}, "product_id")


@query(
    r"""select task_id, epoch_us(ingested_at) ingested_us, array_to_string(list_filter([case when initial_query is null or trim(initial_query) = '' then 'empty' end,
  case when regexp_matches(initial_query, '[$€£]?\d') then 'number' end, case when contains(lower(initial_query), 'laptop') or contains(lower(initial_query), 'weekend') then 'leaked_term' end,
  case when len(list_filter(regexp_split_to_array(trim(initial_query), '\s+'), lambda w: length(w) > 0)) not between 3 and 15 then 'length' end], lambda x: x is not null), ',') problems from tasks"""
)
def f_query_validation(spark, folder):
    """What is wrong with the opening query of each task."""
    t = table(spark, folder, "tasks")
    return t.select("task_id", F.unix_micros("ingested_at").alias("ingested_us"), F.array_join(P.query_problems(F.col("initial_query"), ["laptop", "weekend", "at"]), ",").alias("problems"))


@query(
    """select task_id, epoch_us(ingested_at) ingested_us, array_to_string(list_sort(list_filter(map_keys(user_profile.hard_constraints), lambda k: k not in ('brand', 'storage_type', 'developer'))), ',') unassigned
  from tasks where user_profile.hard_constraints is not null"""
)
def f_plan_validation(spark, folder):
    """Constraint keys that a fixed plan leaves out."""
    t = table(spark, folder, "tasks").where("user_profile.hard_constraints is not null")
    assigned = F.array(*[F.lit(x) for x in ("brand", "storage_type", "developer")])
    return t.select("task_id", F.unix_micros("ingested_at").alias("ingested_us"), F.array_join(P.plan_problems(F.map_keys("user_profile.hard_constraints"), assigned), ",").alias("unassigned"))


@query("""select listing_id, array_to_string(list_filter(list_transform(string_split('a, ''b'',  "c" ,', ','), lambda x: trim(trim(trim(x), '''"'))), lambda x: length(x) > 0), '|') items from laptops""")
def c_parse_list(spark, folder):
    """A list read from text."""
    return table(spark, folder, "laptops").select("listing_id", F.array_join(parse_list(F.lit("a, 'b',  \"c\" ,")), "|").alias("items"))
