"""Queries of joins by order, window frames, partitioned sources, plug-ins, generation and the profile rules."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestock import fixed
from lodestock.functions import plugins
from lodestock.model import Bracket
from lodestock.operators import benchmark, calibrate, evaluate, joins, profile, reports, tasks
from lodestock.plans.common import query
from lodestock.sources.shared import new_path
from lodestock.sources.tables import table


@query("""with v as (select user_id, ts, max(value) as value from events where event_type = 'view' group by 1, 2)
select e.event_id, v.value as last_view from (select * from events where event_type = 'purchase') e asof left join v on v.user_id = e.user_id and v.ts <= e.ts""")
def j_asof(spark, folder):
    """Each purchase with the user's last view before it."""
    e = table(spark, folder, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return joins.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", ["last_view"]).select("event_id", "last_view")


@query("""select a.event_id error_id, count(*) n, round(sum(b.value), 4) total from events a join events b on a.user_id = b.user_id and b.ts >= a.ts and b.ts < a.ts + interval 6 hour
where a.event_type = 'error' and b.event_type = 'click' group by 1""")
def j_interval(spark, folder):
    """Clicks of a user within six hours from each of their errors."""
    e = table(spark, folder, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    spans = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("begin"))
    points = e.where("event_type = 'click'").select("user_id", "value", "at")
    found = joins.interval_join(points, spans, "user_id", F.col("at"), F.col("begin"), F.col("begin") + 6 * 3600, 6 * 3600)
    return found.groupBy("error_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with a as (select l_partkey k, count(*) n from lineitem where l_discount >= 0.1 group by 1), b as (select p_partkey k, p_size from part where p_size > 40)
select coalesce(a.k, b.k) part_key, n, p_size from a full outer join b on a.k = b.k""")
def j_full_outer(spark, folder):
    """Discounted sales and large parts, either without the other too."""
    sold = table(spark, folder, "lineitem").where("l_discount >= 0.1").groupBy(F.col("l_partkey").alias("part_key")).agg(F.count(F.lit(1)).alias("n"))
    large = table(spark, folder, "part").where("p_size > 40").select(F.col("p_partkey").alias("part_key"), "p_size")
    return joins.both_sides(sold, large, "part_key")


@query("""select make, count(*) n, count(vec_id) n_embedded, round(avg(sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) mean_norm from cars left join embeddings on vec_id = car_id group by 1""")
def j_catalog_embeddings(spark, folder):
    """The catalogue with its embeddings by id."""
    e = table(spark, folder, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    c = table(spark, folder, "cars").select("car_id", "make")
    j = c.join(e.select(F.col("vec_id").alias("car_id"), "vec_id", norm.alias("norm")), "car_id", "left")
    return j.groupBy("make").agg(F.count(F.lit(1)).alias("n"), F.count("vec_id").alias("n_embedded"), F.round(F.avg("norm"), 6).alias("mean_norm"))


@query("""select event_id, lag(value) over w previous, lead(value, 2) over w after_next, ntile(4) over w as quarter, round(percent_rank() over w, 6) place, round(cume_dist() over w, 6) share,
round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) rolling, dense_rank() over (partition by user_id order by event_type) kind
from events window w as (partition by user_id order by ts, event_id)""")
def w_frames(spark, folder):
    """Neighbours, quarters, ranks and a rolling mean within each user's events."""
    e = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        "event_id", F.lag("value").over(w).alias("previous"), F.lead("value", 2).over(w).alias("after_next"), F.ntile(4).over(w).alias("quarter"),
        F.round(F.percent_rank().over(w), 6).alias("place"), F.round(F.cume_dist().over(w), 6).alias("share"),
        F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("rolling"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind"),
    )


@query("select l_returnflag, count(*) n, round(sum(l_quantity), 4) quantity from lineitem where l_returnflag in ('A', 'R') group by 1")
def s_partitioned(spark, folder):
    """A table partitioned by a column, read back by partitions."""
    path = new_path(spark, "partitioned")
    table(spark, folder, "lineitem").select("l_returnflag", "l_quantity").repartition("l_returnflag", F.pmod(F.xxhash64("l_quantity"), F.lit(8))).write.partitionBy("l_returnflag").parquet(path)
    back = spark.read.parquet(path).where(F.col("l_returnflag").isin("A", "R"))
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("select event_type, round(exp(avg(ln(value)) filter (value > 0)), 6) mean from events group by 1")
def c_user_aggregate(spark, folder):
    """A user-defined aggregate by name in SQL."""
    plugins.register(spark)
    e = table(spark, folder, "events")
    return spark.sql("select event_type, round(geometric_mean(value), 6) mean from {e} group by event_type", e=e)


@query(r"""with w as (select p_partkey, list_filter(regexp_split_to_array(p_name, '\s+'), lambda x: length(x) > 0) w from part), i as (select p_partkey, w, unnest(range(1, len(w))) i from w)
select w[i] || ' ' || w[i + 1] pair, count(*) n from i group by 1""")
def c_user_table_function(spark, folder):
    """A user-defined table function applied to every row."""
    plugins.register(spark)
    return spark.sql("select pair, count(*) n from {p} p, lateral word_pairs(p.p_name) group by pair", p=table(spark, folder, "part"))


_PREFS = """p as (select task_id, epoch_us(ingested_at) t, k as attribute, case when contains(k, 'max') then 'minimize' when contains(k, 'min') then 'maximize' else '' end direction
  from (select *, unnest(map_keys(user_profile.hard_constraints)) k from tasks))"""


def _preferences(spark, folder):
    """Tasks with preferences made of their constraint keys: a bound above is better low, a bound below better high."""
    way = lambda k: F.when(F.contains(k, F.lit("max")), "minimize").when(F.contains(k, F.lit("min")), "maximize").otherwise("")
    keys = F.map_keys("user_profile.hard_constraints")
    return table(spark, folder, "tasks").select(F.transform(keys, lambda k: F.struct(k.alias("attribute"), way(k).alias("direction"))).alias("attribute_preferences"))


@query(f"with {_PREFS} select attribute, direction, count(*) n from p group by 1, 2")
def g_preference_pairs(spark, folder):
    """How often each preference is used."""
    return tasks.preference_pairs(_preferences(spark, folder))


@query(f"with {_PREFS}, c as (select task_id, t, string_agg(attribute || ':' || direction, '|' order by attribute, direction) combo from p group by 1, 2) select combo, count(*) n from c group by 1")
def g_preference_combos(spark, folder):
    """How often each set of preferences is used."""
    return tasks.preference_combos(_preferences(spark, folder))


@query("select round(sum(value) filter (event_type = 'purchase'), 4) agent_cost, round(sum(value) filter (event_type <> 'purchase'), 4) user_simulator_cost, round(sum(value), 4) total_cost from events")
def g_costs(spark, folder):
    """Costs of both sides and of all; events play the results."""
    e = table(spark, folder, "events")
    bought = F.col("event_type") == "purchase"
    out = evaluate.costs(e.select(F.when(bought, F.col("value")).alias("agent_cost"), F.when(~bought, F.col("value")).alias("user_simulator_cost")))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


_TIERS = [Bracket("medium", 100, 4000, 2, target=12), Bracket("small", 500, 9000, 1, target=6), Bracket("oc_infeasible", 0, 0, 2, target=3)]


def _generated(spark, folder):
    from lodestock.plans.profiling import REGISTRY

    index = calibrate.PoolIndex(table(spark, folder, "laptops"), REGISTRY)
    seen: dict[str, int] = {}

    def accept(tier, constraints, size):
        """Rejects every third set of a tier, as a model that fails would, and names the rest by their constraints."""
        seen[tier] = seen.get(tier, 0) + 1
        return "no_anchor" if seen[tier] % 3 == 0 else {"initial_query": f"{tier} {seen[tier]}"}

    return tasks.generate(index, REGISTRY, _TIERS, random.Random(11), accept)


@query()
def m_generate(spark, folder):
    """Tasks of the generation loop with the size of their pools."""
    made, _ = _generated(spark, folder)
    rows = [(t["difficulty"], t["initial_query"], {k: str(v) for k, v in t["hard_constraints"].items()}, t["pool_size"], t["n_constraints"]) for t in made]
    return spark.createDataFrame(rows, "difficulty string, initial_query string, hard_constraints map<string,string>, pool_size long, n_constraints int").withColumn("hard_constraints", F.to_json("hard_constraints"))


@query()
def g_rejections(spark, folder):
    """Why attempts of the generation loop were rejected."""
    _, rejected = _generated(spark, folder)
    return tasks.rejection_counts(spark.createDataFrame(rejected, "attempt long, difficulty string, reason string"))


@query("""with f as (select p, count(*) n from (select unnest(ports) p from laptops) where p is not null group by 1), t as (select sum(n)::double total, count(*) k from f), r as (select n, row_number() over (order by n desc, p) i from f)
select 'string' element_type, round((select total from t) / (select count(ports) from laptops), 4) mean_elements, (select count(*) from f where n = 1) n_singletons, round((select sum(-n / total * log2(n / total)) / log2(max(k)) from f, t), 6) entropy, """
    + ", ".join(f"round((select sum(n) from r where i <= {k}) / (select total from t), 6) top{k}_share" for k in (1, 3, 5, 10)))
def g_list_elements(spark, folder):
    """Elements of a list column: type, singletons, entropy, concentration."""
    out = profile.element_profile(table(spark, folder, "laptops"), "ports")
    return out.withColumns({c: F.round(c, 6) for c in ("entropy", *(f"top{k}_share" for k in (1, 3, 5, 10)))})


@query("""with j as (select json_array(event_id, props, value, null, event_type = 'view') a from events), e as (select unnest(json_extract(a, '$[*]')) x from j)
select case json_type(x) when 'UBIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'number' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' end element_type, count(*) n from e group by 1""")
def g_element_types(spark, folder):
    """Types of the elements of JSON lists."""
    e = table(spark, folder, "events")
    cells = F.concat(F.lit("["), F.concat_ws(",", F.col("event_id").cast("string"), F.lit('"x"'), F.col("value").cast("string"), F.lit("null"), (F.col("event_type") == "view").cast("string")), F.lit("]"))
    out = profile.element_types(e.select(cells.alias("a")), "a")
    kind = F.when(F.col("element_type").isin("decimal", "double"), "number").otherwise(F.col("element_type"))
    return out.groupBy(kind.alias("element_type")).agg(F.sum("n").alias("n"))


#: Columns of the profiled tables by what their type is to the rules.
_COLUMNS = {
    "laptops": {"listing_id": "n", "load_id": "n", "product_id": "s", "name": "s", "brand": "s", "processor": "s", "storage_type": "s", "display_type": "s", "gpu_type": "s", "webcam_resolution": "s", "os_version": "s", "price": "f", "ram_gb": "n", "storage_gb": "n", "screen_inches": "f", "refresh_rate_hz": "n", "weight_kg": "f", "battery_hours": "f", "avg_rating": "f", "num_reviews": "n", "touchscreen": "b", "backlit_keyboard": "b", "numeric_keypad": "b", "ports": "l", "use_cases": "s", "description": "s", "scraped_at": "t", "loaded_at": "t"},
    "cars": {"car_id": "n", "year": "n", "make": "s", "model": "s", "msrp": "f", "engine_hp": "f", "engine_cylinders": "n", "engine_fuel_type": "s", "transmission_type": "s", "driven_wheels": "s", "number_of_doors": "n", "vehicle_size": "s", "vehicle_style": "s", "market_category": "s", "highway_mpg": "n", "city_mpg": "n", "popularity": "n"},
    "games": {"game_id": "n", "name": "s", "developer": "s", "genres": "l", "categories": "l", "supported_platforms": "s", "supported_languages": "l", "full_audio_languages": "l", "publishers": "l", "price": "f", "release_date": "t", "positive": "n", "negative": "n", "recommendations": "n", "achievements": "n", "average_playtime_forever": "n", "dlc_count": "n", "estimated_owners": "n", "peak_ccu": "n", "short_description": "s"},
}


def _stats_sql() -> str:
    """One row per column with what the rules need."""
    rows = []
    for t, columns in _COLUMNS.items():
        for place, (c, kind) in enumerate(columns.items()):
            v = {"n": f"{c}::double", "f": f"(case when isfinite({c}) then {c} end)", "t": f"(epoch_us({c}) / 1e6)::double", "b": f"{c}::int::double", "s": f"nullif(length({c}), 0)::double"}.get(kind, "null::double")
            labels = f"(select count(distinct x) from (select unnest({c}) x from {t}))" if kind == "l" else "0"
            elements = f"(select count(x) from (select unnest({c}) x from {t}))" if kind == "l" else "0"
            spread = "0::double" if kind in "sb" else f"stddev_pop({v})"
            rows.append(f"select '{t}' table_name, '{c}' column_name, {place} place, '{kind}' t, count(*) n_rows, count({c}) n, count(distinct {c}) u, min({v}) lo, max({v}) hi, avg({v}) mean, {spread} sd, bool_and({v} in (0, 1)) flag, bool_and({v} = floor({v})) whole, {elements} el, {labels} labels from {t}")
    kinds = """case when n = 0 then 'all_null' when t = 'l' then 'list_of_values' when t = 'b' or (t in ('n', 'f') and flag) then 'bool' when t = 't' then 'datetime'
      when t in ('n', 'f') then (case when whole then 'int_numeric' else 'float_numeric' end) when mean > 120 or hi > 500 then 'string_long_text' else 'string_categorical' end"""
    noise = "case " + " ".join(f"when regexp_matches(lower(column_name), '{p}') then '{tag}'" for tag, p in fixed.NOISE_PATTERNS.items()) + " end"
    named = f"u >= {fixed.ID_UNIQUENESS} * n_rows and (regexp_matches(lower(column_name), '{fixed.ID_WORD}') or lower(column_name) in {fixed.ID_NAMES})"
    number, rate = "kind in ('int_numeric', 'float_numeric', 'datetime')", "1 - n / n_rows::double"
    tag = lambda when, name: f"case when {when} then '{name}' end"
    tags = [
        tag(number, "filterable_numeric"), tag(f"{number} and {rate} > 0.4", "sparse"), tag(f"{number} and coalesce(sd, 0) > 0", "has_variance"), tag(f"{number} and coalesce(sd, 0) <= 0", "low_or_no_variance"),
        tag(f"{number} and u <= 2", "binary_or_trivial"), tag(f"{number} and u between 3 and 5000", "good_cardinality_for_buckets"),
        tag(f"kind = 'string_categorical' and {rate} < 0.2 and u between 2 and 10000", "filterable_categorical"), tag("kind = 'string_categorical' and u = 1", "constant_column"), tag("kind = 'string_categorical' and u > 0.5 * n_rows", "high_uniqueness_like_free_text"),
        tag("kind = 'list_of_values'", "multi_value_per_row"), tag("kind = 'list_of_values' and labels between 2 and 10000", "filterable_after_flattening_or_membership"), tag("kind = 'list_of_values' and labels = 1", "single_repeated_tag_only"),
        tag("kind = 'string_long_text'", "long_text_may_support_description_constraints"), tag("kind = 'bool'", "filterable_boolean"), tag("kind = 'all_null'", "limited_tabular_filter_use"),
        tag(named, "candidate_identifier_column"), noise, tag("kind = 'list_of_values' and el < 100 and n_rows >= 1000", "noise_near_empty_list"),
    ]
    return f"""raw as ({" union all ".join(rows)}), kinds as (select *, {kinds} kind, {rate} null_rate from raw), tagged as (select *, list_filter([{", ".join(tags)}], lambda x: x is not null) tags from kinds),
    noisy as (select *, coalesce((list_filter(tags, lambda x: starts_with(x, 'noise_')))[1], case when kind = 'all_null' then 'all values null' when u <= 1 and n_rows > 0 then 'constant column' end) noise from tagged)"""


@query(f"""with {_stats_sql()}, s as (select a.table_name, a.column_name, string_agg(b.column_name, ',' order by b.column_name) siblings from raw a join raw b on a.table_name = b.table_name and a.column_name <> b.column_name
  and least(length(a.column_name), length(b.column_name)) >= 3 and (starts_with(a.column_name, b.column_name) or starts_with(b.column_name, a.column_name)) group by 1, 2)
select t.table_name, t.column_name, kind, array_to_string(tags, ',') tags, coalesce(siblings, '') siblings from tagged t left join s on s.table_name = t.table_name and s.column_name = t.column_name""")
def g_kind_tags(spark, folder):
    """Inferred kind, tags and sibling names of every column of three tables."""
    rows = [(t, p.name, p.kind, ",".join(p.tags), ",".join(p.details.get("siblings", []))) for t in _COLUMNS for p in profile.profile_columns(table(spark, folder, t))]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string, tags string, siblings string")


@query(f"""with {_stats_sql()}, why as (select *, case when kind = 'all_null' then 'all null' when n_rows > 0 and u = 1 then 'constant column' when noise is not null then 'noise: ' || noise when null_rate > 0.7 and kind <> 'string_long_text' then 'sparse'
  when kind = 'bool' and mean is not null and not mean between 0.05 and 0.95 then 'near-constant boolean' when kind in ('int_numeric', 'float_numeric') and regexp_matches(column_name, '{fixed.AUDIT_TIME}', 'i') and coalesce(lo, 0) > 1e9 then 'audit timestamp'
  when lower(column_name) in {fixed.SCHEMA_NAMES} then 'schema metadata' when kind in ('int_numeric', 'float_numeric') and ends_with(column_name, '_n') and exists (select 1 from kinds k where k.table_name = noisy.table_name and k.kind = 'list_of_values'
    and k.column_name in (left(noisy.column_name, length(noisy.column_name) - 2), left(noisy.column_name, length(noisy.column_name) - 2) || '_tags')) then 'redundant count of list' end reason from noisy),
kept as (select table_name, max(n_rows) n_rows, count(*) k, count(*) filter (list_contains(tags, 'has_variance')) nums, count(*) filter (list_contains(tags, 'filterable_after_flattening_or_membership')) sets,
  count(*) filter (list_contains(tags, 'filterable_categorical') or list_contains(tags, 'filterable_boolean')) others, count(*) filter (kind = 'string_long_text') texts, count(*) filter (null_rate <= 0.2) filled, count(*) filter (null_rate > 0.5) sparse from why where noise is null group by 1),
scored as (select table_name, greatest(1, least(10, round_even(5.0 + case when n_rows < 1000 then -1 when n_rows >= 10000 then 0.5 else 0 end + case when nums + sets + others >= 8 then 1.5 when nums + sets + others >= 4 then 0.5 else 0 end
  + 0.5 * (nums >= 2)::int + 0.3 * (texts >= 1)::int + 0.3 * (sets >= 1)::int - (sparse > 0.5 * k)::int - 0.5 * (filled < greatest(2, k // 3))::int, 0)))::int score from kept)
select table_name, column_name, reason, score, case when score >= 8 then 'strong' when score >= 6 then 'good' when score >= 4 then 'fair' else 'weak' end verdict from why join scored using (table_name)""")
def g_triage_rules(spark, folder):
    """Columns that the triage rules drop, with the reason, and the table's score."""
    rows = []
    for t in _COLUMNS:
        ps = profile.profile_columns(table(spark, folder, t))
        score = profile.assess(ps)
        rows += [(t, c, why, score["score"], score["verdict"]) for c, why in profile.triage(ps).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, reason string, score int, verdict string")


@query("""with n as (select table_name t, column_name c from information_schema.columns where table_name in ('laptops', 'cars', 'games'))
select a.t table_name, a.c as name, b.c as sibling from n a join n b on a.t = b.t and a.c <> b.c and least(length(a.c), length(b.c)) >= 3 and (starts_with(a.c, b.c) or starts_with(b.c, a.c))""")
def j_prefix_siblings(spark, folder):
    """Columns of which one name begins with another's, by a join of the tables' column names."""
    names = [(t, c) for t in _COLUMNS for c in table(spark, folder, t).columns]
    a = spark.createDataFrame(names, "table_name string, name string")
    b = a.withColumnRenamed("name", "sibling")
    long = F.least(F.length("name"), F.length("sibling")) >= 3
    return a.join(b, "table_name").where((F.col("name") != F.col("sibling")) & long & (F.startswith("name", F.col("sibling")) | F.startswith("sibling", F.col("name")))).select("table_name", "name", "sibling")


_DOMAINS = {"laptops": ("listing_id", "price", "num_reviews"), "cars": ("car_id", "msrp", "popularity"), "games": ("game_id", "price", "recommendations")}


def _benchmark_sql(domain: str) -> str:
    """The benchmark over products and tasks as they stand, one by one."""
    key, price, popular = _DOMAINS[domain]
    plain = "coalesce(try_cast({0} as double)::varchar, lower(trim({0})))"
    attributes = {"laptops": {"brand": "s", "storage_type": "s", "os_version": "s", "price": "n", "ram_gb": "n", "gpu_type": "s", "touchscreen": "b", "weight_kg": "n"}, "cars": {"transmission_type": "s", "driven_wheels": "s", "msrp": "n", "make": "s", "year": "n"}}[domain]
    text = "case attribute " + " ".join(f"when '{a}' then lower({a}::varchar)" for a, k in attributes.items() if k != "n") + " end"
    value = "case attribute " + " ".join(f"when '{a}' then (case when isnan({a}::double) then null else {a}::double end)" for a, k in attributes.items() if k == "n") + " end"
    return f"""with pairs as (select distinct name, attribute, operator, unnest(sampling_values) v from constraint_specs where domain = '{domain}' and operator is not null and not coalesce(desc_constraint, false)),
q as (select *, {plain.format("v")} p from pairs where v is not null and attribute in ({", ".join(f"'{a}'" for a in attributes)})),
t as (select task_id, arg_max(difficulty, (ingested_at, difficulty)) difficulty, arg_max(infeasible, (ingested_at, difficulty)) infeasible, arg_max(user_profile.hard_constraints, (ingested_at, difficulty)) c from tasks where domain = '{domain}' and task_id is not null group by 1),
e as (select task_id, unnest(map_entries(c)) e from t), asked as (select distinct task_id, name, v from e join q on q.name = e.key and q.p = {plain.format("e.value")}),
sets as (select task_id, coalesce(list_sort(list(name || '=' || v) filter (where name is not null)), []) s from t left join asked using (task_id) group by 1), each as (select distinct s from sets),
sat as (select {key} pid, q.name, q.v from {domain}, q where case when operator in ('eq', 'in_set') then coalesce({text}, '') = lower(v) when operator = 'lte' then coalesce({value} <= try_cast(v as double), false) when operator = 'gte' then coalesce({value} >= try_cast(v as double), false) else false end),
need as (select s, unnest(s) x from each), hit as (select s, pid from need join sat on name || '=' || v = x group by s, pid having count(*) = any_value(len(s)) union all select s, {key} from each, {domain} where len(s) = 0),
prod as (select {key} pid, case when isnan({price}::double) then null else {price}::double end price, {popular} pop from {domain}),
pool as (select s, count(*) n, min(price) lo, max(price) hi from hit join prod using (pid) group by 1),
cheap as (select s, pid from hit join prod using (pid) where price is not null qualify row_number() over (partition by s order by price, pid) <= 3), top as (select pid from prod order by pop desc nulls last, pid limit 3),
recs as (select 'cheapest' policy, s, pid from cheap union all select 'popular', s, pid from each, top),
scored as (select policy, r.s, count(*) n, count(h.pid) good, min(case when h.pid is not null then price end) best from recs r join prod using (pid) left join hit h on h.s = r.s and h.pid = r.pid group by 1, 2),
res as (select p.policy, difficulty, infeasible, coalesce(pool.n, 0) pool_size, case when coalesce(scored.n, 0) > 0 then good / scored.n::double else 1 end csr, case when pool.n is null then coalesce(infeasible, false)::int::double
  when coalesce(good, 0) = 0 or best is null then 0 when hi = lo then 1 else 0.5 + 0.5 * (hi - best) / (hi - lo) end reward from t join sets using (task_id) cross join (select unnest(['cheapest', 'popular']) policy) p
  left join pool on pool.s = sets.s left join scored on scored.s = sets.s and scored.policy = p.policy)
select policy, d difficulty, count(*) n_tasks, count(*) filter (pool_size = 0) n_empty, round(avg(pool_size), 6) mean_pool, round(avg(csr), 6) csr, round(avg(reward), 6) reward from (select *, coalesce(difficulty, '(none)') d from res) group by grouping sets ((policy), (policy, d))"""


def _benchmark(spark, folder, domain):
    key, price, popular = _DOMAINS[domain]
    registry = benchmark.registry_of(table(spark, folder, "constraint_specs"), domain)
    tasks_of = table(spark, folder, "tasks").where(F.col("domain") == domain)
    return benchmark.Benchmark(table(spark, folder, domain), tasks_of, registry, product=key, price=price, popularity=popular)


def _rounded(out):
    return out.withColumns({c: F.round(c, 6) for c in ("mean_pool", "csr", "reward")})


@query(_benchmark_sql("laptops"))
def x_benchmark_laptops(spark, folder):
    """Two policies over all tasks of a domain: catalogue, constraints, pools, rewards, report."""
    return _rounded(_benchmark(spark, folder, "laptops").report(["cheapest", "popular"]))


@query(_benchmark_sql("cars"))
def x_benchmark_cars(spark, folder):
    """The same over another domain."""
    return _rounded(_benchmark(spark, folder, "cars").report(["cheapest", "popular"]))


@query("""with k as (select task_id, epoch_us(ingested_at) t, unnest(map_entries(user_profile.hard_constraints)) e from tasks),
n as (select *, case when contains(e.key, 'max') then 'reactive: shown_wrong_' || e.key when contains(e.key, 'min') then 'proactive' else 'responsive' end tag from k)
select task_id, t ingested_us, string_agg('- ' || e.key || ': ' || coalesce(e.value, '') || '  [' || tag || ']', chr(10) order by e.key) as lines from n group by 1, 2""")
def m_constraint_lines(spark, folder):
    """Constraints of each task as lines for a simulated user, with when they are told."""
    t = table(spark, folder, "tasks").where("cardinality(user_profile.hard_constraints) > 0")
    c = F.col("user_profile.hard_constraints")
    modes = F.transform_values(c, lambda k, v: F.when(F.contains(k, F.lit("max")), "reactive").when(F.contains(k, F.lit("min")), "proactive").otherwise("responsive"))
    triggers = F.transform_values(F.map_filter(c, lambda k, v: F.contains(k, F.lit("max"))), lambda k, v: F.concat(F.lit("shown_wrong_"), k))
    return t.select("task_id", F.unix_micros("ingested_at").alias("ingested_us"), F.array_join(reports.constraint_lines(c, modes, triggers), "\n").alias("lines"))


@query("""select coalesce(event_type, 'overall') difficulty, count(*) n, round(avg(value), 6) reward, case when grouping(event_type) = 1 then 1 else 0 end as is_all from events group by rollup (event_type)""")
def m_ranking_table(spark, folder):
    """Means over all results and by tier; events play the results."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("difficulty"), F.col("value").alias("reward"))
    out = reports.ranking_table(e, ["reward"])
    return out.select("difficulty", "n", F.round("reward", 6).alias("reward"), (F.col("difficulty") == "overall").cast("int").alias("is_all"))
