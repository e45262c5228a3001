"""Queries of profiling, calibration, descriptions, joins, sets and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestock import fixed
from lodestock.model import Bracket, ConstraintSpec
from lodestock.operators import assembly, calibrate, configgen, desc, profile, resolve, tasks
from lodestock.plans.common import CAT, TASKS, catalog, query, tasks25
from lodestock.sources.shared import new_path
from lodestock.sources.tables import table
from lodestock.streaming import results


def _r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _stats(c, v):
    return f"select '{c}' column_name, count({v}) n, min({v}) as min, max({v}) as max, round(avg({v}), 6) mean, round(stddev_pop({v}), 6) std, round(quantile_cont({v}, 0.05), 6) p5, round(quantile_cont({v}, 0.5), 6) p50, round(quantile_cont({v}, 0.95), 6) p95 from x"


@query("with x as (select case when isnan(price) then null else price end price, num_reviews::double num_reviews from laptops) " + " union all ".join(_stats(c, c) for c in ("price", "num_reviews")))
def g_numeric_profile(spark, folder):
    """Statistics of number columns."""
    return _r6(profile.numeric_profile(table(spark, folder, "laptops"), ["price", "num_reviews"]), "mean", "std", "p5", "p50", "p95")


@query(
    """with x as (select num_reviews::double v from laptops where num_reviews is not null), q as (select quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 from x)
  select max(q3 - q1) iqr, round(stddev_pop(v) / abs(avg(v)), 6) cv, round(avg((v = 0)::int), 6) share_zero, count(*) filter (v < 0) n_negative,
  count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) n_outliers, count(distinct round(v, 8)) n_distinct from x, q"""
)
def g_numeric_extras(spark, folder):
    """Spread, zeros, outliers of a number column."""
    return _r6(profile.numeric_extras(table(spark, folder, "laptops"), "num_reviews"), "cv", "share_zero")


@query(" union all ".join(f"select '{c}' column_name, count({c}) n_non_null, count(*) filter ({c} = '') n_empty, min(length({c})) filter ({c} <> '') min_len, max(length({c})) filter ({c} <> '') max_len, round(avg(length({c})) filter ({c} <> ''), 6) mean_len from laptops" for c in ("name", "processor")))
def g_string_profile(spark, folder):
    """Lengths of text columns."""
    return _r6(profile.string_profile(table(spark, folder, "laptops"), ["name", "processor"]), "mean_len")


@query(
    r"""with x as (select text, length(text)::double n, len(list_filter(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+'), lambda w: length(w) > 0))::double k from documents)
  select round(quantile_cont(n, 0.5), 6) len_p50, round(quantile_cont(n, 0.9), 6) len_p90, round(quantile_cont(n, 0.99), 6) len_p99, round(quantile_cont(k, 0.5), 6) words_p50, round(quantile_cont(k, 0.9), 6) words_p90,
  max(k)::bigint words_max, count(text) - count(distinct text) n_duplicates from x"""
)
def g_text_profile(spark, folder):
    """Lengths, words and repeats of texts."""
    out = profile.text_profile(table(spark, folder, "documents"), "text").withColumn("words_max", F.col("words_max").cast("long"))
    return _r6(out, "len_p50", "len_p90", "len_p99", "words_p50", "words_p90")


_FREQ = "f as (select brand as value, count(*) n from laptops where brand is not null group by 1), t as (select sum(n)::double total from f)"


@query(f"with {_FREQ} select count(*) n_values, round(sum(-n / total * log2(n / total)) / log2(count(*)), 6) entropy from f, t")
def g_entropy(spark, folder):
    """Normalised entropy of a column."""
    return _r6(profile.entropy(table(spark, folder, "laptops"), "brand"), "entropy")


@query(f"with {_FREQ}, r as (select n, total, row_number() over (order by n desc, value) k from f, t) select " + ", ".join(f"round(sum(n) filter (k <= {k}) / max(total), 6) top{k}_share" for k in (1, 3, 5, 10)) + " from r")
def g_concentration(spark, folder):
    """Share of the most frequent values."""
    return _r6(profile.concentration(table(spark, folder, "laptops"), "brand"), *[f"top{k}_share" for k in (1, 3, 5, 10)])


@query(f"with {_FREQ} select value, n, round(n / total, 6) share from f, t order by n desc, value limit 10")
def g_top_values(spark, folder):
    """The most frequent values."""
    return profile.top_values(table(spark, folder, "laptops"), "brand")


@query("""with f as (select storage_type v, count(*) n from laptops where storage_type is not null group by 1) select count(*) n_distinct, count(*) filter (n = 1) n_singletons, count(distinct lower(trim(v))) n_normalised,
  case when count(*) <= 1 then 'none' when count(*) <= 20 then 'eq' when count(*) <= 5000 then 'in_set' else 'substring' end suggested from f""")
def g_categorical_extras(spark, folder):
    """Cardinality of a text column."""
    return profile.categorical_extras(table(spark, folder, "laptops"), "storage_type")


@query("""select min(len(ports)) min_len, max(len(ports)) max_len, round(avg(len(ports)), 6) mean_len, quantile_cont(len(ports), 0.5)::double p50_len, (select count(p) from (select unnest(ports) p from laptops)) n_elements,
  (select count(distinct p) from (select unnest(ports) p from laptops)) n_distinct from laptops""")
def g_list_profile(spark, folder):
    """Lengths and elements of a list column."""
    return _r6(profile.list_profile(table(spark, folder, "laptops"), "ports"), "mean_len")


@query("select unnest(json_keys(props)) as key, count(*) n from events group by 1")
def g_json_keys(spark, folder):
    """Keys of JSON objects."""
    return profile.key_frequencies(table(spark, folder, "events"), "props")


@query("select k as key, count(*) n from (select unnest(map_keys(user_profile.hard_constraints)) k from tasks) group by 1")
def g_map_keys(spark, folder):
    """Keys of maps."""
    return profile.key_frequencies(table(spark, folder, "tasks").select(F.col("user_profile.hard_constraints").alias("c")), "c")


@query(" union all ".join(f"select '{c}' column_name, count(*) n_analyzed, count({c}) n_non_null, round(1 - count({c}) / count(*)::double, 4) null_rate, count(distinct {c}) n_unique, round(coalesce(count(distinct {c}) / nullif(count({c}), 0)::double, 0), 4) uniqueness_ratio from games" for c in ("name", "genres", "peak_ccu")))
def g_null_unique(spark, folder):
    """Null rates and distinct counts, lists by their content."""
    return profile.null_unique(table(spark, folder, "games"), ["name", "genres", "peak_ccu"])


REGISTRY = [
    ConstraintSpec("price_max", "price", "lte", sampling_values=[600, 800, 1000, 1500]),
    ConstraintSpec("ram_min", "ram_gb", "gte", sampling_values=[8, 16, 32]),
    ConstraintSpec("brand", "brand", "eq", sampling_values=["Brightmoor", "Zelkova", "Quay & Co", "N/A", "Nobody"]),
]
_HITS = {("price_max", v): f"coalesce(price <= {v} and not isnan(price), false)" for v in (600, 800, 1000, 1500)}
_HITS |= {("ram_min", v): f"coalesce(ram_gb >= {v}, false)" for v in (8, 16, 32)}
_HITS |= {("brand", v): f"coalesce(lower(brand), '') = '{v.lower()}'" for v in ("Brightmoor", "Zelkova", "Quay & Co", "N/A", "Nobody")}
_RATES = "rates as (" + " union all ".join(f"select '{n}' as name, '{v}' as value, count(*) filter ({c}) hits, avg(({c})::int) rate from laptops" for (n, v), c in _HITS.items()) + ")"


@query(f"with {_RATES} select name, value, hits, round(rate, 6) rate from rates")
def g_hit_rates(spark, folder):
    """Share of rows that each sampling value matches, in one scan."""
    return _r6(calibrate.hit_rates(table(spark, folder, "laptops"), REGISTRY), "rate")


@query(f"with {_RATES} select name, value, hits, round(rate, 6) rate from rates where rate >= 0.005 and lower(value) <> 'n/a'")
def g_prune_values(spark, folder):
    """Sampling values worth keeping."""
    return _r6(calibrate.pruned(calibrate.hit_rates(table(spark, folder, "laptops"), REGISTRY)), "rate")


@query(f"with {_RATES} select name, count(*) filter (rate >= 0.005 and lower(value) <> 'n/a') n_values, count(*) filter (rate >= 0.005 and lower(value) <> 'n/a') >= 2 viable from rates group by 1")
def g_viability(spark, folder):
    """Constraints with values enough."""
    return calibrate.viability(calibrate.pruned(calibrate.hit_rates(table(spark, folder, "laptops"), REGISTRY)), [c.name for c in REGISTRY])


@query(f"with {_RATES} select name, round(median(rate), 6) restrictiveness from rates group by 1")
def g_restrictiveness(spark, folder):
    """Median hit rate by constraint."""
    return _r6(calibrate.restrictiveness(calibrate.hit_rates(table(spark, folder, "laptops"), REGISTRY)), "restrictiveness")


def _sets(df):
    by = {(n, v): m for n, v, m in calibrate.candidates(df, REGISTRY)}
    return {f"{p}|{r}": [by["price_max", p], by["ram_min", r]] for p in (600, 800, 1000, 1500) for r in (8, 16, 32)}


_POOLS = "pools as (" + " union all ".join(f"select '{p}|{r}' set_id, count(*) filter ({_HITS['price_max', p]} and {_HITS['ram_min', r]}) pool_size from laptops" for p in (600, 800, 1000, 1500) for r in (8, 16, 32)) + ")"


@query(f"with {_POOLS} select * from pools")
def o_pool_index(spark, folder):
    """Pool sizes of many conjunctions in one scan."""
    df = table(spark, folder, "laptops")
    return calibrate.pool_sizes(df, _sets(df))


@query("select " + " + ".join(f"(case when {c} then {1 << i} else 0 end)" for i, c in enumerate(_HITS.values())) + "::bigint signature, count(*) n from laptops group by 1")
def o_pool_signature(spark, folder):
    """Counts of rows by which of all masks hold."""
    df = table(spark, folder, "laptops")
    return calibrate.signatures(df, [m for _, _, m in calibrate.candidates(df, REGISTRY)])


@query(f"with {_POOLS} select count(*) n_samples, " + ", ".join(f"round(quantile_cont(pool_size, {p / 100}), 6) p{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + ", round(count(*) filter (pool_size = 0) / count(*)::double, 6) zero_rate, round(count(*) filter (pool_size between 1 and 3) / count(*)::double, 6) small_rate from pools")
def g_calibration_percentiles(spark, folder):
    """Distribution of pool sizes."""
    out = calibrate.calibration(o_pool_index(spark, folder))
    return _r6(out, *[c for c in out.columns if c != "n_samples"])


@query(f"""with {_POOLS}, s as (select pool_size, contains(set_id, '600|') or contains(set_id, '800|') cheap from pools) select 'cheap' as name, round(median(pool_size) filter (cheap), 6) median_with, round(median(pool_size) filter (not cheap), 6) median_without,
  round(1 - median(pool_size) filter (cheap) / greatest(median(pool_size) filter (not cheap), 1), 6) reduction, count(*) filter (cheap) n_with, count(*) filter (not cheap) n_without from s""")
def g_marginal_effects(spark, folder):
    """Median pool with and without a constraint."""
    pools = o_pool_index(spark, folder)
    cheap = F.contains("set_id", F.lit("600|")) | F.contains("set_id", F.lit("800|"))
    samples = pools.select("pool_size", F.when(cheap, F.array(F.lit("cheap"))).otherwise(F.array().cast("array<string>")).alias("names"))
    return _r6(calibrate.marginal_effects(samples, ["cheap"]), "median_with", "median_without", "reduction")


BRACKETS = [Bracket("low", 0, 1000, target=3), Bracket("mid", 500, 3000, target=2), Bracket("none", 10**9, 10**9 + 1, target=1)]


@query(f"with {_POOLS}, b as (select * from (values ('low', 0, 1000, 3), ('mid', 500, 3000, 2), ('none', 1000000000, 1000000001, 1)) b(tier, lo, hi, target)) select tier, b.target::bigint target, count(pool_size) viable, round(count(pool_size) / 12.0::double, 6) coverage, count(pool_size) >= 2 * b.target sufficient from b left join pools on pool_size between lo and hi group by tier, b.target")
def j_bracket_range(spark, folder):
    """Range join of pool sizes with difficulty brackets."""
    return _r6(calibrate.bracket_coverage(o_pool_index(spark, folder), BRACKETS), "coverage")


@query(f"""with {_POOLS}, q as (select floor(quantile_cont(pool_size, 0.2))::bigint p20, floor(quantile_cont(pool_size, 0.4))::bigint p40, floor(quantile_cont(pool_size, 0.8))::bigint p80 from pools where pool_size > 3)
select 'large' tier, 4::bigint lo, greatest(p20, 5) hi from q union all select 'medium', greatest(p20 - 2, 4), greatest(p40 + 5, p20 + 5) from q union all select 'small', greatest(p40 - 5, p20), greatest(p80, p40 + 10) from q
union all select 'oc_feasible', 1, 3 from q union all select 'oc_infeasible', 0, 0 from q""")
def g_bracket_tune(spark, folder):
    """Brackets proposed from pool sizes."""
    return calibrate.tuned(o_pool_index(spark, folder))


@query(f"""with {_POOLS}, k as (select case when contains(set_id, '|8') then 1 when contains(set_id, '|16') then 2 else 3 end k, pool_size from pools),
s as (select k, median(pool_size) as median, avg((pool_size between 500 and 3000)::int) inside from k group by 1) select k, round(median, 6) as median, round(inside, 6) inside, round(inside - 0.01 * abs(median - 1750) / 1750, 6) score from s order by inside - 0.01 * abs(median - 1750) / 1750 desc, k limit 1""")
def g_best_count(spark, folder):
    """The constraint count whose pools fit best."""
    k = F.when(F.contains("set_id", F.lit("|8")), 1).when(F.contains("set_id", F.lit("|16")), 2).otherwise(3)
    return _r6(calibrate.best_count(o_pool_index(spark, folder).select(k.alias("k"), "pool_size"), 500, 3000), "median", "inside", "score")


@query("""with f as (select g as value, count(*) n from (select unnest(genres) g from games) where g is not null group by 1), s as (select value, n, round(n / sum(n) over (), 6) share from f),
w as (select *, row_number() over (order by share desc, value) place, coalesce(sum(share) over (order by share desc, value rows between unbounded preceding and 1 preceding), 0) before from s)
select value, n, share, place from w where place <= 50 and (place <= 3 or (before < 0.9 and share >= 0.002))""")
def w_coverage_values(spark, folder):
    """Values by share until 90 % are covered."""
    return configgen.covering_values(profile.frequencies(table(spark, folder, "games"), "genres"))


@query("select distinct round_even(unnest([quantile_cont(v, 0.05), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 0.95)]), 0) point from (select num_reviews::double v from laptops)")
def c_sampling_points(spark, folder):
    """Rounded percentiles as sampling values."""
    return configgen.sampling_points(table(spark, folder, "laptops"), F.col("num_reviews").cast("double"))


@query("""select distinct strftime(make_timestamp((round_even(unnest([quantile_cont(v, 0.05), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 0.95)]), 0) * 1000000)::bigint), '%Y-%m-%d') point from (select epoch_us(o_orderdate) / 1e6::double v from orders)""")
def c_date_points(spark, folder):
    """Percentiles of dates as sampling values."""
    return configgen.date_points(table(spark, folder, "orders"), F.col("o_orderdate"))


@query(f"with {CAT} select 'p_retailprice' attribute, 'range' kind, round(max(p_retailprice) - min(p_retailprice), 6) measure, max(p_retailprice) > min(p_retailprice) usable from cat union all select 'n_sold', 'range', (max(n_sold) - min(n_sold))::double, max(n_sold) > min(n_sold) from cat union all select 'p_brand', 'match', round(avg((lower(p_brand) = 'brand#11')::int), 6), avg((lower(p_brand) = 'brand#11')::int) between 0.05 and 0.95 from cat")
def t_pref_variance(spark, folder):
    """Attributes that vary enough to be preferences."""
    return _r6(tasks.preference_variance(catalog(spark, folder), ["p_retailprice", "n_sold"], {"p_brand": "Brand#11"}), "measure")


@query("""with t as (select task_id, ingested_at, infeasible, metadata.structured_pool_size pool, coalesce(cardinality(user_profile.hard_constraints), 0)::bigint n from tasks)
select task_id, epoch_us(ingested_at) ingested_us, case when coalesce(infeasible, false) then 'oc_infeasible' when pool <= 3 then 'oc_feasible' when n // 3 >= 2 and pool <= 200 and n >= 5 then 'large' when (case when n > 0 then 1 - (n // 2) / n::double else 1 end) < 0.4 and n // 3 = 0 then 'small' else 'medium' end tier from t""")
def c_difficulty(spark, folder):
    """Tier from pool size and revelation counts."""
    t = table(spark, folder, "tasks")
    n = F.coalesce(F.size(F.map_keys("user_profile.hard_constraints")), F.lit(0)).cast("long")
    n = F.when(F.col("user_profile.hard_constraints").isNull(), 0).otherwise(n)
    tier = configgen.difficulty(F.col("infeasible"), F.col("metadata.structured_pool_size"), n, F.floor(n / 2), F.floor(n / 3), 200, 5)
    return t.select("task_id", F.unix_micros("ingested_at").alias("ingested_us"), tier.alias("tier"))


@query("""with t as (select n, tier from (select unnest(range(0, 12)) n) a, (select unnest(['small', 'medium', 'large', 'oc_feasible']) tier) b),
f as (select *, case when n = 0 then 0 when tier = 'small' then greatest(1, floor(n * 0.6) + (n > 1)::int) when tier = 'large' then greatest(1, least(floor(n * 0.25), n - 2)) when tier = 'oc_feasible' then greatest(1, floor(n * 0.3)) else greatest(1, floor(n * 0.4)) end::bigint first from t),
l as (select *, greatest(0, case tier when 'small' then 0 when 'large' then least(2, n - first) else least(1, n - first) end)::bigint late from f) select n, tier, first as proactive, n - first - late as responsive, late as reactive from l""")
def c_revelation_counts(spark, folder):
    """How many constraints are told when, by tier."""
    n = spark.range(12).withColumnRenamed("id", "n").crossJoin(spark.createDataFrame([(x,) for x in ("small", "medium", "large", "oc_feasible")], "tier string"))
    a, b, c = configgen.revelation_counts(F.col("n"), F.col("tier"))
    return n.select("n", "tier", a.alias("proactive"), b.alias("responsive"), c.alias("reactive"))


def _described(spark, folder):
    """Card-like attributes of cars in long form: the raw keys of one meaning differ by make year."""
    c = table(spark, folder, "cars")
    raw = F.when(F.col("year") >= 2010, "fuel").otherwise("engine_fuel")
    parts = [c.select(F.col("car_id").cast("string").alias("pid"), raw.alias("attr"), F.col("engine_fuel_type").alias("value"), F.lit(0).alias("pos"))]
    for i, name in enumerate(("vehicle_size", "number_of_doors"), 1):
        parts.append(c.select(F.col("car_id").cast("string").alias("pid"), F.lit(name).alias("attr"), F.col(name).cast("string").alias("value"), F.lit(i).alias("pos")))
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), parts).where("value is not null and attr is not null")


_LONG = """long as (select car_id::varchar pid, case when year >= 2010 then 'fuel' else 'engine_fuel' end attr, engine_fuel_type as value, 0 pos from cars union all select car_id::varchar, 'vehicle_size', vehicle_size, 1 from cars
  union all select car_id::varchar, 'number_of_doors', number_of_doors::varchar, 2 from cars), l as (select * from long where value is not null)"""


@query(f"""with {_LONG}, v as (select attr, lower(trim(value)) v, count(*) n from l group by 1, 2), s as (select attr, sum(n)::bigint n, count(*) n_distinct, max(n) top_n, (list(v order by n desc, v))[1] top_value,
  bool_and(v in ('true', 'false')) flag, bool_and(try_cast(v as double) is not null) num from v group by 1), c as (select count(*)::double total from cars)
select attr, n, round(n / total, 6) coverage, case when flag then 'boolean' when num then 'numeric' else 'categorical' end attr_type, n_distinct, top_value, round(top_n / n::double, 6) dominance, n / total >= 0.05 and top_n / n::double <= 0.95 passes from s, c""")
def g_attr_coverage(spark, folder):
    """Coverage, type and dominance of described attributes."""
    out = desc.attribute_coverage(_described(spark, folder), table(spark, folder, "cars").count())
    return _r6(out, "coverage", "dominance")


@query(f"""with {_LONG}, n as (select attr, count(*) n from l group by 1), w as (select attr, n, coalesce(sum(n) over (order by n desc, attr rows between unbounded preceding and 1 preceding), 0) before, sum(n) over () total from n)
select attr, n, case when before < 0.7 * total then 1 else 2 end tier from w""")
def g_key_tiers(spark, folder):
    """Keys that cover most values, and the rest."""
    return desc.key_tiers(_described(spark, folder), 0.7)


@query(f"""with {_LONG}, m as (select * from (values ('fuel', 'a'), ('engine_fuel', 'a'), ('vehicle_size', 'a'), ('number_of_doors', 'b')) m(raw, canonical)) select pid, canonical as attr, (list(value order by pos, value))[1] as value from l join m on raw = attr group by 1, 2""")
def j_canonical_first(spark, folder):
    """Raw keys mapped to canonical ones, the first value of each kept."""
    m = spark.createDataFrame([("fuel", "a"), ("engine_fuel", "a"), ("vehicle_size", "a"), ("number_of_doors", "b")], "raw string, canonical string")
    return desc.canonical_first(_described(spark, folder), m, "pos")


@query(f"with {_LONG}, v as (select attr, value, count(*) n from l group by 1, 2) select attr, sum(n)::bigint n, array_to_string((list(value order by value))[1:12], '|') samples from v group by 1")
def g_key_samples(spark, folder):
    """Keys with sample values."""
    return desc.key_samples(_described(spark, folder)).withColumn("samples", F.array_join("samples", "|"))


@query(f"with {_LONG}, v as (select attr, lower(trim(value)) as value, count(*) n from l group by 1, 2) select attr, value, n from v qualify row_number() over (partition by attr order by n desc, value) <= 15")
def g_attr_values(spark, folder):
    """The most frequent values of each described attribute."""
    return desc.attribute_values(_described(spark, folder))


@query("select distinct domain, anchor from (select domain, metadata.anchor_product_id anchor from tasks) where anchor is not null and anchor not in (select product_id from laptops where product_id is not null)")
def j_anti_missing(spark, folder):
    """Anchors of tasks, of any domain, that the catalogue of laptops lacks."""
    a = table(spark, folder, "tasks").select("domain", F.col("metadata.anchor_product_id").alias("anchor")).where("anchor is not null").distinct()
    return a.join(table(spark, folder, "laptops").select(F.col("product_id").alias("anchor")), "anchor", "left_anti").select("domain", "anchor")


_OUT = ", ".join(f"'{w}'" for w in fixed.UNUSABLE_VALUES)


@query(f"""with v as (select trim(e.value) v from (select unnest(map_entries(user_profile.hard_constraints)) e from tasks) union all select '{{"lang": "fr", "text": " ' || brand || ' "}}' from laptops union all select '{{"x": 1}}'),
c as (select case when starts_with(v, '{{') and trim(coalesce(json_extract_string(v, '$.text'), '')) <> '' then trim(json_extract_string(v, '$.text')) else v end as value from v where v is not null)
select value, count(*) n from c where lower(value) not in ({_OUT}) group by 1""")
def c_sanitised(spark, folder):
    """Sampling values without those that are none; JSON objects by their text."""
    t = table(spark, folder, "tasks").select(F.explode("user_profile.hard_constraints").alias("k", "value")).select("value")
    b = table(spark, folder, "laptops").select(F.concat(F.lit('{"lang": "fr", "text": " '), "brand", F.lit(' "}')).alias("value"))
    rows = t.unionByName(b).unionByName(spark.createDataFrame([('{"x": 1}',)], "value string"))
    return configgen.sanitised(rows).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


_EMPTY = ", ".join(f"'{w}'" for w in fixed.EMPTY_DESCRIPTIONS)


@query(f"select car_id, market_category from cars where length(trim(market_category)) > 0 and lower(trim(market_category)) not in ({_EMPTY})")
def f_usable_text(spark, folder):
    """Rows whose text says something."""
    return desc.usable(table(spark, folder, "cars"), "market_category").select("car_id", "market_category")


@query("select p_partkey, coalesce(n, 0) n from part left join (select l_partkey, count(*) n from lineitem where l_quantity >= 45 group by 1) on l_partkey = p_partkey")
def j_left_default(spark, folder):
    """Left join with a default."""
    n = table(spark, folder, "lineitem").where("l_quantity >= 45").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, folder, "part")
    return p.join(n, p["p_partkey"] == n["l_partkey"], "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("select distinct product_id from laptops where product_id in (select product_id from documents where product_id is not null)")
def j_semi(spark, folder):
    """Products with documents."""
    return table(spark, folder, "laptops").select("product_id").distinct().join(table(spark, folder, "documents").select("product_id"), "product_id", "left_semi")


@query("select distinct model from cars where model is not null except select distinct model from cars where year >= 2015 and model is not null")
def u_except(spark, folder):
    """Set difference."""
    c = table(spark, folder, "cars").where("model is not null")
    return c.select("model").subtract(c.where("year >= 2015").select("model"))


@query("select distinct brand from laptops where ram_gb >= 32 intersect select distinct brand from laptops where price < 700 and not isnan(price)")
def u_intersect(spark, folder):
    """Set intersection."""
    x = table(spark, folder, "laptops")
    return x.where("ram_gb >= 32").select("brand").intersect(x.where("price < 700 and not isnan(price)").select("brand"))


@query("select make as name from cars union select brand from laptops")
def u_union_dedup(spark, folder):
    """Union without repeats."""
    return table(spark, folder, "cars").select(F.col("make").alias("name")).union(table(spark, folder, "laptops").select("brand")).distinct()


@query("select task_id, initial_query from (select *, row_number() over (partition by lower(trim(initial_query)) order by ingested_at, task_id) r from tasks where initial_query is not null) where r = 1")
def u_query_dedup(spark, folder):
    """The first task of each opening query."""
    t = table(spark, folder, "tasks").where("initial_query is not null").withColumn("o", F.struct("ingested_at", "task_id"))
    return tasks.dedup_queries(t, "initial_query", F.col("o")).select("task_id", "initial_query")


@query("select e.key as name, e.value as value, count(*) n from (select unnest(map_entries(user_profile.hard_constraints)) e from tasks) group by 1, 2")
def g_diversity(spark, folder):
    """How often each constraint value is used."""
    return tasks.diversity(table(spark, folder, "tasks").select(F.col("user_profile.hard_constraints").alias("hard_constraints")))


@query("""with t as (select difficulty, metadata.structured_pool_size p, coalesce(cardinality(user_profile.hard_constraints), 0)::double n from tasks where difficulty is not null), g as (select * from (values ('easy', 100), ('medium', 100), ('hard', 50), ('absent', 5)) g(difficulty, target))
select difficulty, target::bigint target, count(t.n) n, min(p) pool_min, round(median(p), 6) pool_median, max(p) pool_max, round(avg(t.n), 6) mean_constraints from g left join t using (difficulty) group by 1, 2""")
def g_generation_summary(spark, folder):
    """Tasks against targets by tier."""
    k = F.when(F.col("user_profile.hard_constraints").isNull(), 0).otherwise(F.size("user_profile.hard_constraints"))
    t = table(spark, folder, "tasks").select("difficulty", F.col("metadata.structured_pool_size").alias("pool_size"), k.alias("n_constraints"))
    targets = spark.createDataFrame([("easy", 100), ("medium", 100), ("hard", 50), ("absent", 5)], "difficulty string, target long")
    return _r6(tasks.generation_summary(t, targets), "pool_median", "mean_constraints")


@query()
def r_kmeans_reps(spark, folder):
    """Representatives of the embeddings: one vector per cluster, in two batches."""
    return desc.representatives(table(spark, folder, "embeddings"), 8, "vec_id", batches=2)


@query()
def c_fuzzy_ratio(spark, folder):
    """Matching-blocks ratio of distinct brands with a word; no SQL function computes it."""
    b = table(spark, folder, "laptops").select("brand").distinct()
    return b.select("brand", F.round(resolve.similarity(F.col("brand"), "brightmor"), 6).alias("ratio"))


@query()
def x_list_values_fuzzy(spark, folder):
    """Brands alike a misspelt one; the measure has no SQL function, tested apart."""
    from lodestock.operators import explore

    return _r6(explore.list_values_similar(table(spark, folder, "laptops"), "brand", "brihgtmor"), "ratio")


@query("select date_trunc('day', ts::timestamp) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def x_tumbling(spark, folder):
    """Daily windows of events, in batch."""
    return results.tumbling(table(spark, folder, "events"), "1 day", "event_type").withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("select date_trunc('day', ts::timestamp) as start, event_type, count(*) n from events group by 1, 2")
def x_stream_results(spark, folder):
    """The same windows as a stream that reads what there is and stops."""
    schema = table(spark, folder, "events").schema
    stream = results.event_time(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(folder, "events")))
    found = results.run_available(results.tumbling(stream, "1 day", "event_type"), new_path(spark, "stream"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _as_folder(folder: str, name: str) -> str:
    """A file stream reads folders: the table's own, or the glob that matches its file only."""
    import os

    path = f"{folder}/{name}.parquet"
    return path if os.path.isdir(path) else f"{folder}/{name}.parque[t]"


@query("""with e as (select user_id, ts::timestamp ts, case when ts::timestamp - lag(ts::timestamp) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, min(ts) as start, max(ts) + interval 30 minute as end, count(*) n from s group by user_id, k""")
def x_stream_session(spark, folder):
    """Sessions of users, in batch."""
    return results.sessions(table(spark, folder, "events"), "30 minutes", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select p_brand, p_size, count(*) n, round(sum(p_retailprice), 4) total from part group by cube (p_brand, p_size)")
def x_cube(spark, folder):
    """All groupings of two columns."""
    return table(spark, folder, "part").cube("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"))


@query(f"with {TASKS} select task_id, price_max, size_max, difficulty from tasks25")
def m_task_table(spark, folder):
    """The tasks that evaluation queries use."""
    return tasks25(spark, folder).select("task_id", "price_max", F.col("size_max"), "difficulty")


@query("""select task_id, epoch_us(ingested_at) ingested_us, array_to_string(list_sort(list_distinct(list_filter(list_transform(map_values(user_profile.hard_constraints), lambda v: lower(trim(v))),
  lambda v: v is not null and length(v) >= 3 and v not in ('true', 'false', 'none', 'null') and try_cast(v as double) is null))), '|') terms from tasks where user_profile.hard_constraints is not null""")
def m_forbidden_terms(spark, folder):
    """Words of constraint values that a query must not give away."""
    t = table(spark, folder, "tasks").where("user_profile.hard_constraints is not null")
    terms = F.array_sort(assembly.forbidden_terms(F.col("user_profile.hard_constraints")))
    return t.select("task_id", F.unix_micros("ingested_at").alias("ingested_us"), F.array_join(terms, "|").alias("terms"))


@query("""select game_id, concat_ws(' | ', name, case when developer is not null then 'by: ' || developer end, case when release_date is not null then 'on: ' || strftime(release_date, '%Y-%m-%d') end,
  case when average_playtime_forever >= 60 then 'plays: ' || printf('%,.1f', ((average_playtime_forever + 3) // 6) / 10.0::double) || ' h' when average_playtime_forever is not null then 'plays: ' || average_playtime_forever::varchar || ' min' end) line
  from games """)
def c_one_line(spark, folder):
    """Products in one line."""
    g = table(spark, folder, "games")
    line = assembly.one_line({"": F.col("name"), "by": F.col("developer"), "on": assembly.day(F.col("release_date")), "plays": assembly.duration(F.col("average_playtime_forever"))})
    return g.select("game_id", line.alias("line"))


@query("""with t as (select e.key as attribute from (select unnest(map_entries(user_profile.hard_constraints)) e from tasks where user_profile.hard_constraints is not null))
select attribute, case when contains(attribute, 'max') then 'lower ' || replace(attribute, '_', ' ') when contains(attribute, 'min') then 'higher ' || replace(attribute, '_', ' ') else replace(attribute, '_', ' ') || ' = x' end as label, count(*) n from t group by 1, 2""")
def c_preference_label(spark, folder):
    """Preferences as text."""
    t = table(spark, folder, "tasks").select(F.explode("user_profile.hard_constraints").alias("attribute", "v"))
    direction = F.when(F.contains("attribute", F.lit("max")), "minimize").when(F.contains("attribute", F.lit("min")), "maximize").otherwise("match")
    return t.groupBy("attribute", assembly.preference_label(F.col("attribute"), direction, F.lit("x")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""with o as (select distinct brand from laptops where brand is not null) select brand, row_number() over (order by brand) pos, case when lower(brand) in ('odrin', 'ilyx') then 'renamed' else brand end as recoded from o""")
def c_recode(spark, folder):
    """Values put into other words."""
    from pyspark.sql import Window

    o = table(spark, folder, "laptops").where("brand is not null").select("brand").distinct()  # a few brands
    words = {w: "renamed" for b in ("Odrin", "Ilyx") for w in (b, b.lower(), b.upper(), b.swapcase())}
    return o.select("brand", F.row_number().over(Window.orderBy("brand")).alias("pos"), assembly.recoded(F.col("brand"), words).alias("recoded"))


@query(" union all ".join(f"select '{c}' column_name, '{t}' dtype, round(avg(({c} is not null)::int), 6) filled, case when min({c}::varchar) = max({c}::varchar) then min({c}::varchar) else min({c}::varchar) || '|' || max({c}::varchar) end examples from cars" for c, t in (("make", "string"), ("year", "int"), ("popularity", "bigint"))))
def m_column_context(spark, folder):
    """Columns with their type, share filled and examples."""
    out = assembly.column_context(table(spark, folder, "cars").select("make", "year", "popularity"))
    return _r6(out, "filled").withColumn("examples", F.array_join("examples", "|"))


@query("""with m as (select lower(trim(source)) task_id, contains(lower(text), 'battery') b, contains(lower(text), 'weight') or contains(lower(text), 'light') w from documents where text is not null),
f as (select task_id, bool_or(b) b, bool_or(w) w from m group by 1) select task_id, 3::bigint n_keys, 1 + b::int + w::int n_revealed, round((1 + b::int + w::int) / 3.0::double, 6) completeness from f where task_id is not null""")
def g_elicitation_update(spark, folder):
    """Keys drawn out by trigger words: documents play the messages, their sources the conversations."""
    from lodestock.operators import evaluate

    d = table(spark, folder, "documents").where("text is not null").select(F.lower(F.trim("source")).alias("task_id"), "text").where("task_id is not null")
    keys = spark.createDataFrame([("power", "battery_min"), ("weight", "weight_max"), (None, "brand")], "trigger string, key string")
    plan = d.select("task_id").distinct().crossJoin(F.broadcast(keys))  # three keys
    return _r6(evaluate.revealed(d, plan, {"power": ["battery"], "weight": ["weight", "light"]}), "completeness")
