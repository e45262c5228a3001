"""Queries of exploration, scoring, evaluation and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestock.functions import text as X
from lodestock.model import ConstraintSpec, Preference
from lodestock.operators import evaluate as E
from lodestock.operators import explore, policies, scoring, search
from lodestock.operators.predicates import constraint_filter
from lodestock.plans.common import CAT, POOLS, RECS, TASKS, catalog, query, recs, tasks25
from lodestock.sources.shared import keep
from lodestock.sources.tables import table

REGISTRY = [
    ConstraintSpec("price_max", "p_retailprice", "lte"),
    ConstraintSpec("size_max", "p_size", "lte"),
    ConstraintSpec("tags_any", "tags", "contains_any"),
]
PREFS = [Preference("p_retailprice", "minimize", priority=1), Preference("n_sold", "maximize", priority=2)]
_U = """s as (select min(p_retailprice) plo, max(p_retailprice) phi, min(n_sold)::double slo, max(n_sold)::double shi from pool),
u as (select pool.*, (2.0::double / 3) * (case when phi = plo then 1 else (phi - p_retailprice) / (phi - plo) end)
  + (1.0::double / 3) * (case when n_sold is null then 0 when shi = slo then 1 else (n_sold - slo) / (shi - slo) end) utility from pool, s)"""


@query(f"""with {CAT}, pool as (select * from cat where p_retailprice <= 950 and p_size <= 20 and list_has_any(tags, ['red', 'blue'])), {_U}
select p_partkey, p_name, round(utility, 6) utility from u order by u.utility desc, p_partkey limit 10""")
def flagship(spark, folder):
    """Constraints, pool statistics, utility, top ten."""
    pool = constraint_filter(catalog(spark, folder), {"price_max": 950, "size_max": 20, "tags_any": ["red", "blue"]}, REGISTRY)
    top = scoring.score_pool(pool, PREFS).orderBy(F.col("utility").desc(), "p_partkey").limit(10)
    return top.select("p_partkey", "p_name", F.round("utility", 6).alias("utility"))


@query("""select listing_id, product_id, price from laptops where ram_gb >= 16 order by case when isnan(price) then null else price end desc nulls last, listing_id limit 50""")
def t_filter_sort_limit(spark, folder):
    """Filtered head by price, nulls last."""
    df = table(spark, folder, "laptops").withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    out = explore.filter_sort_limit(df, {"ram": 16}, [ConstraintSpec("ram", "ram_gb", "gte")], "listing_id", "price", True, 50)
    return out.select("listing_id", "product_id", "price")


@query("select car_id, make, model from cars order by car_id limit 30")
def t_head(spark, folder):
    """The first rows without filters."""
    return explore.filter_sort_limit(table(spark, folder, "cars"), {}, [], "car_id").select("car_id", "make", "model")


@query("select make as value, count(*) n from cars where make is not null group by 1")
def x_list_values(spark, folder):
    """Values of a column with counts."""
    return explore.list_values(table(spark, folder, "cars"), "make")


@query("select value, count(*) n from (select unnest(ports) as value from laptops) where value is not null group by 1")
def x_list_values_set(spark, folder):
    """Elements of a list column with counts."""
    return explore.list_values(table(spark, folder, "laptops"), "ports")


@query("""select arg_min(g, game_id) as value, count(*) n from (select game_id, unnest(genres) g from games) where g is not null and (contains(lower(trim(g)), 'ac') or contains('ac', lower(trim(g)))) group by lower(trim(g))""")
def x_list_values_query(spark, folder):
    """Values that hold the query, in their first spelling."""
    return explore.list_values_matching(table(spark, folder, "games"), "genres", "AC", "game_id")


@query("select * from (select p_partkey, unnest(['p_name', 'p_brand', 'p_size']) as label, unnest([p_name, p_brand, p_size::varchar]) as value, unnest([0, 1, 2])::int place from part) where value is not null")
def x_details_unpivot(spark, folder):
    """Details of every part as (label, value) rows."""
    return explore.details(table(spark, folder, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])


@query("""select (select p_partkey from part where p_partkey in (3, 14, 15) order by p_retailprice, p_partkey limit 1) cheapest, (select p_partkey from part where p_partkey in (3, 14, 15) order by p_size desc, p_partkey limit 1) largest""")
def x_compare_highlights(spark, folder):
    """Extremes among compared items."""
    return explore.highlights(table(spark, folder, "part").where(F.col("p_partkey").isin(3, 14, 15)), "p_partkey", {"cheapest": ("p_retailprice", "min"), "largest": ("p_size", "max")})


@query("""with c as (select * from cars), t as (select make, count(*) n from c where make is not null group by 1 order by 2 desc, 1 limit 8)
select 'year' part, 'min' as label, min(year)::double as value from c union all select 'year', 'max', max(year)::double from c union all select 'year', 'avg', round(avg(year), 6) from c
union all select 'engine_hp', 'min', min(engine_hp) from c where not isnan(engine_hp) union all select 'engine_hp', 'max', max(engine_hp) from c where not isnan(engine_hp)
union all select 'engine_hp', 'avg', round(avg(engine_hp), 6) from c where not isnan(engine_hp) union all select 'make', make, n::double from t""")
def x_result_summary(spark, folder):
    """Summary of a result set."""
    from lodestock.sources.readers import normalised

    return explore.summary(normalised(table(spark, folder, "cars")), ["year", "engine_hp"], ["make"]).withColumn("value", F.round("value", 6))


@query("""select count(*) n, min(p) min_price, max(p) max_price, median(p) median_price, count(distinct brand) n_brand, count(distinct ram_gb) n_ram_gb from (select *, case when isnan(price) then null else price end p from laptops)""")
def x_catalog_stats(spark, folder):
    """Statistics of the catalogue."""
    return explore.catalog_stats(table(spark, folder, "laptops"), "price", ["brand", "ram_gb"])


@query("""select count(v) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, min(v) as min, quantile_cont(v, 0.25) p25, quantile_cont(v, 0.5) p50, quantile_cont(v, 0.75) p75, max(v) as max from (select num_reviews::double v from laptops)""")
def x_describe_number(spark, folder):
    """Distribution of a number."""
    return explore.describe_number(table(spark, folder, "laptops"), "num_reviews").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(r"""select listing_id, regexp_replace(lower(trim(name, ' ')), '[ \t\n\x0B\f\r]+', ' ', 'g') plain, regexp_replace(brand, '^[a-z]{2}:', '') unprefixed from laptops""")
def c_text_normalise(spark, folder):
    """White space, letter case, prefixes."""
    return table(spark, folder, "laptops").select("listing_id", X.squeeze(F.col("name")).alias("plain"), X.strip_prefix(F.col("brand")).alias("unprefixed"))


@query(r"""select game_id, case when price = 0 then 'Free to Play' when price is not null then '$' || printf('%,.2f', price) end price_label,
  case when len(g) > 3 then array_to_string(g[1:3], ', ') || ' (+' || (len(g) - 3)::varchar || ' more)' when len(g) > 0 then array_to_string(g, ', ') end genre_label
  from (select *, list_filter(genres, lambda x: x is not null) g from games)""")
def c_formatting(spark, folder):
    """Prices, whatever their size or absent, and shortened lists of every game as text."""
    return table(spark, folder, "games").select("game_id", X.price(F.col("price")).alias("price_label"), X.short_list(F.col("genres")).alias("genre_label"))


@query("""with r as (select game_id, coalesce(positive, 0) p, coalesce(positive, 0) + coalesce(negative, 0) n from games)
select game_id, case when n > 0 then floor(100.0::double * p / n + 0.5)::bigint::varchar || '% positive of ' ||
  case when n >= 1e6 then printf('%.1f', floor(n / 1e5) / 10) || 'M' when n >= 1e3 then printf('%.1f', floor(n / 1e2) / 10) || 'K' else n::varchar end end reviews from r""")
def c_review_summary(spark, folder):
    """Share of positive reviews as text."""
    return table(spark, folder, "games").select("game_id", X.review_summary(F.col("positive"), F.col("negative")).alias("reviews"))


@query("select car_id, concat_ws(' > ', make, vehicle_size, vehicle_style) as path, case when lower(trim(transmission_type)) in ('true', '1', 'yes', 'y', 't') then true when lower(trim(transmission_type)) in ('false', '0', 'no', 'n', 'f') then false end flag from cars")
def c_path_bool(spark, folder):
    """Paths of levels and flags read from text."""
    return table(spark, folder, "cars").select("car_id", X.path(F.col("make"), F.col("vehicle_size"), F.col("vehicle_style")).alias("path"), X.parse_bool(F.col("transmission_type")).alias("flag"))


@query(r"""select token, count(*) n from (select unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) token from documents) where length(token) >= 2 group by 1""")
def c_tokenise_freq(spark, folder):
    """Tokens of all documents with counts."""
    return table(spark, folder, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CAT} select min(p_retailprice) p_retailprice_min, max(p_retailprice) p_retailprice_max, coalesce(min(n_sold)::double, 0) n_sold_min, coalesce(max(n_sold)::double, 0) n_sold_max from cat")
def w_pool_stats(spark, folder):
    """Pool minimum and maximum of preference attributes."""
    return scoring.pool_stats(catalog(spark, folder), PREFS)


@query(f"with {CAT}, pool as (select * from cat where p_size <= 25), {_U} select p_partkey, round(utility, 6) utility from u")
def w_utility(spark, folder):
    """Utility of every product of a pool."""
    pool = catalog(spark, folder).where("p_size <= 25")
    return scoring.score_pool(pool, PREFS).select("p_partkey", F.round("utility", 6).alias("utility"))


@query(f"""with {CAT}, {TASKS}, {POOLS}, m as (select *, max(round(utility, 6)) over (partition by task_id) top from pools)
select task_id, pid, round(utility, 6) utility from m where round(utility, 6) = top""")
def w_rank_best_ties(spark, folder):
    """The best products of every task's pool, ties included."""
    pools = _pools(spark, folder).withColumn("utility", F.round("utility", 6))
    return scoring.ranked(pools, "pid", ["task_id"]).where("best").select("task_id", "pid", "utility")


def _pools(spark, folder):
    found = policies.task_pools(catalog(spark, folder), tasks25(spark, folder), "p_partkey", {"p_retailprice": "price_max", "p_size": "size_max"})
    scored = scoring.score_pool(found, PREFS, ["task_id"])
    # Rewards, ideal orders and violations all read the pools: they are made once.
    return keep(scored.select("task_id", "difficulty", F.col("p_partkey").alias("pid"), "utility"), "pools")


_REWARD = f"""with {CAT}, {TASKS}, {RECS}, {POOLS}, r as (select task_id, min(utility) low, max(utility) high from pools group by 1),
b as (select task_id, max(utility) best from recs join pools using (task_id, pid) group by 1),
rewards as (select task_id, best, case when best is null then 0 when high = low then 1 else 0.5 + 0.5 * (best - low) / (high - low) end reward from r left join b using (task_id))"""


@query(f"{_REWARD} select task_id, round(best, 6) best, round(reward, 6) reward from rewards")
def w_reward(spark, folder):
    """Reward of each task's recommendations."""
    out = E.rewards(recs(spark, folder), _pools(spark, folder))
    return out.select("task_id", F.round("best", 6).alias("best"), F.round("reward", 6).alias("reward"))


_CSR = "c as (select recs.task_id, count(*) n, count(*) filter (p.pid is null) n_violating from recs left join pools p on p.task_id = recs.task_id and p.pid = recs.pid group by 1)"


def _violating(r, pools):
    return r.join(pools.select("task_id", "pid"), ["task_id", "pid"], "left_anti").select("task_id", "pid")


@query(f"with {CAT}, {TASKS}, {RECS}, {POOLS}, {_CSR} select task_id, n, n_violating, round(1 - n_violating / n::double, 6) csr from c")
def w_csr(spark, folder):
    """Constraint satisfaction of each task's recommendations."""
    r, pools = recs(spark, folder), _pools(spark, folder)
    out = E.satisfaction(r, _violating(r, pools), catalog(spark, folder), id_column="p_partkey")
    return out.withColumn("csr", F.round("csr", 6))


_NDCG = f"""with {CAT}, {TASKS}, {RECS}, {POOLS}, g as (select recs.task_id, recs.pos, coalesce(utility, 0) rel from recs left join pools p on p.task_id = recs.task_id and p.pid = recs.pid),
i as (select task_id, utility, row_number() over (partition by task_id order by utility desc, pid) place from pools),
a as (select task_id, count(*) n, sum(rel) captured, sum(case when pos <= 1 then rel / log2(pos + 1) else 0 end) d1, sum(case when pos <= 3 then rel / log2(pos + 1) else 0 end) d3, sum(case when pos <= 5 then rel / log2(pos + 1) else 0 end) d5, sum(rel / log2(pos + 1)) dn from g group by 1),
b as (select i.task_id, sum(utility) total, max(utility) top, sum(case when place <= 1 then utility / log2(place + 1) else 0 end) i1, sum(case when place <= 3 then utility / log2(place + 1) else 0 end) i3, sum(case when place <= 5 then utility / log2(place + 1) else 0 end) i5,
  sum(case when place <= n then utility / log2(place + 1) else 0 end) idn from i join a using (task_id) group by 1),
m as (select a.task_id, n, coalesce(case when i1 > 0 then d1 / i1 end, 0) ndcg_1, coalesce(case when i3 > 0 then d3 / i3 end, 0) ndcg_3, coalesce(case when i5 > 0 then d5 / i5 end, 0) ndcg_5, coalesce(case when idn > 0 then dn / idn end, 0) ndcg_n,
  coalesce(case when top > 0 then captured / (n * top) end, 0) p, coalesce(case when total > 0 then captured / total end, 0) r from a left join b using (task_id))"""


@query(f"{_NDCG} select task_id, n num_recommendations, round(ndcg_1, 6) ndcg_1, round(ndcg_3, 6) ndcg_3, round(ndcg_5, 6) ndcg_5, round(ndcg_n, 6) ndcg_n from m")
def w_ndcg(spark, folder):
    """NDCG of each task's recommendations."""
    out = E.ranking_metrics(recs(spark, folder), _pools(spark, folder))
    return out.select("task_id", "num_recommendations", *[F.round(c, 6).alias(c) for c in ("ndcg_1", "ndcg_3", "ndcg_5", "ndcg_n")])


@query(f"{_NDCG} select task_id, round(p, 6) graded_precision, round(r, 6) graded_recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) graded_f1 from m")
def w_graded_prf(spark, folder):
    """Graded precision, recall and F1."""
    out = E.ranking_metrics(recs(spark, folder), _pools(spark, folder))
    return out.select("task_id", *[F.round(c, 6).alias(c) for c in ("graded_precision", "graded_recall", "graded_f1")])


@query("""select user_id as task_id, event_type as pid, row_number() over (partition by user_id order by first, event_type) pos from (select user_id, event_type, min(event_id) as first from events group by 1, 2)""")
def w_dedup_recs(spark, folder):
    """Repeated recommendations once, in order of first place."""
    r = table(spark, folder, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("pid"))
    return E.dedup_recommendations(r)


def _results(spark, folder, r):
    pools = _pools(spark, folder)
    out = E.evaluate(r, pools, _violating(r, pools), catalog(spark, folder), "p_partkey")
    return out.join(tasks25(spark, folder).select("task_id", "difficulty"), "task_id", "right")


@query(f"""{_REWARD}, {_CSR}, res as (select t.task_id, difficulty, reward, 1 - n_violating / n::double csr from tasks25 t left join rewards using (task_id) left join c using (task_id))
select difficulty, count(*) n_tasks, round(avg(coalesce(reward, 0)), 6) reward, round(coalesce(avg(csr), 0), 6) csr from res group by grouping sets ((), (difficulty))""")
def g_difficulty_rollup(spark, folder):
    """Results over all tasks and by difficulty."""
    out = E.by_difficulty(_results(spark, folder, recs(spark, folder)), ["reward"], ["csr"])
    return out.select("difficulty", "n_tasks", F.round("reward", 6).alias("reward"), F.round("csr", 6).alias("csr"))


def _trials(spark, folder):
    """Each user's events as trials: the value is the reward, a purchase a success."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("trial"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("success"), "event_type")


@query("""select user_id task_id, count(*) n_trials, round(avg(value), 6) reward, round(stddev_samp(value), 6) reward_std, round(avg((event_type = 'purchase')::int), 6) success, round(stddev_samp((event_type = 'purchase')::int), 6) success_std,
  arg_min(event_type, event_id) event_type, (list(event_id order by value desc, event_id))[1] best_trial from events group by 1""")
def g_trials(spark, folder):
    """Results of several trials by task."""
    out = E.by_task_over_trials(_trials(spark, folder), ["reward", "success"], ["event_type"])
    return out.select("task_id", "n_trials", *[F.round(c, 6).alias(c) for c in ("reward", "reward_std", "success", "success_std")], "event_type", "best_trial")


@query("""with s as (select user_id % 5 seed, avg(value) v from events group by 1) select count(*) n_seeds, round(avg(v), 6) reward_mean, round(coalesce(stddev_samp(v), 0), 6) reward_std from s""")
def g_seeds(spark, folder):
    """Mean and deviation over seeds."""
    out = E.over_seeds(table(spark, folder, "events").select((F.col("user_id") % 5).alias("seed"), F.col("value").alias("reward")), ["reward"])
    return out.select("n_seeds", F.round("reward_mean", 6).alias("reward_mean"), F.round("reward_std", 6).alias("reward_std"))


@query("""select task_id, epoch_us(ingested_at) ingested_us, round(case when len(k) > 0 then len(list_filter(k, lambda x: x in ('brand', 'price_max_usd', 'developer'))) / len(k)::double else 1 end, 6) completeness
  from (select *, map_keys(user_profile.hard_constraints) k from tasks where user_profile.hard_constraints is not null)""")
def g_elicitation(spark, folder):
    """Share of each task's constraint keys among those revealed."""
    t = table(spark, folder, "tasks").where("user_profile.hard_constraints is not null")
    told = F.array(*[F.lit(x) for x in ("brand", "price_max_usd", "developer")])
    return t.select("task_id", F.unix_micros("ingested_at").alias("ingested_us"), F.round(E.elicitation(F.map_keys("user_profile.hard_constraints"), told), 6).alias("completeness"))


@query("select difficulty, infeasible, case when coalesce(infeasible, false) then 1.0 else 0.0 end::double reward, count(*) n from tasks group by all")
def w_infeasible_reward(spark, folder):
    """Reward for declaring a task infeasible."""
    t = table(spark, folder, "tasks").withColumn("reward", E.infeasible_reward(F.col("infeasible"), F.lit(True)))
    return t.groupBy("difficulty", "infeasible", "reward").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CAT}, {TASKS}, {POOLS} select task_id, row_number() over (partition by task_id order by utility desc, pid) pos, pid from pools qualify pos <= 3")
def a_topk(spark, folder):
    """Policy: the best of each pool."""
    return policies.top_k(_pools(spark, folder).withColumn("score", F.col("utility")), 3)


@query(f"""with {CAT}, {TASKS}, {POOLS}, hits as (select p_partkey pid, p_size::double score from part where contains(p_name, 'red'))
select task_id, row_number() over (partition by task_id order by score desc nulls last, pid) pos, pid from pools left join hits using (pid) qualify pos <= 5""")
def a_oracle(spark, folder):
    """Policy: satisfying products, search hits first."""
    pools = _pools(spark, folder)
    hits = table(spark, folder, "part").where("contains(p_name, 'red')").select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("score"))
    return policies.oracle(pools.select("task_id", "pid").join(hits, "pid"), pools, 5)


@query()
def a_random_hash(spark, folder):
    """Policy: products in an order by hash; the hash is Spark's own, so SQL elsewhere can't repeat it."""
    return policies.random_k(_pools(spark, folder), 3)


@query(f"with {CAT}, {TASKS}, {POOLS} select task_id + 100 * hard task_id from (select *, unnest([0, 1]) hard from tasks25) where task_id not in (select task_id from pools) or hard = 1")
def a_infeasible(spark, folder):
    """Tasks without a satisfying product: those that are asked for at a price below all as well."""
    t = tasks25(spark, folder)
    cheap = t.withColumns({"task_id": F.col("task_id") + 100, "price_max": F.lit(1.0)})
    found = policies.task_pools(catalog(spark, folder), t.unionByName(cheap), "p_partkey", {"p_retailprice": "price_max", "p_size": "size_max"})
    return policies.infeasible_tasks(t.unionByName(cheap), found.select("task_id"))


_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2))"


def _exact_sql(words, partial_counts=False, popularity=False):
    ws = sorted(set(words))
    part = lambda i, w: f"len(list_filter(t, lambda x: contains(x, '{w}') or contains('{w}', x))) > 0 as h{i}, list_contains(t, '{w}') as e{i}"
    df = lambda i: f"count(*) filter (e{i}{f' or h{i}' if partial_counts else ''}) d{i}"
    score = " + ".join(f"{words.count(w)} * (case when e{i} then 1 when h{i} then 0.5 else 0 end)::double * (ln((n + 1.0) / (d{i} + 1.0)) + 1)" for i, w in enumerate(ws))
    return f"""with r as (select *, {", ".join(part(i, w) for i, w in enumerate(ws))} from (select *, {_TOK} t from laptops)), s as (select count(*)::double n, {", ".join(df(i) for i in range(len(ws)))} from r),
  q as (select r.*, {score} score from r, s)"""


@query(_exact_sql(["rugged", "battery", "track"]) + " select listing_id, round(score, 6) score from q where score > 0 order by q.score desc, listing_id limit 100")
def r_keyword_exact_idf(spark, folder):
    """Keyword search by tokens."""
    found = search.keyword_by_token(table(spark, folder, "laptops"), "rugged battery track", ["description"])
    return search.top(found, "listing_id", 100).select("listing_id", F.round("score", 6).alias("score"))


@query(
    r"""with r as (select *, lower(concat_ws(' ', name, description)) b, regexp_split_to_array(lower(concat_ws(' ', name, description)), '[^a-z0-9]+') t from laptops),
  s as (select count(*)::double n, count(*) filter (contains(b, 'slate')) d0, count(*) filter (contains(b, 'key')) d1 from r),
  q as (select listing_id, (case when list_contains(t, 'slate') then 1 when contains(b, 'slate') then 0.5 else 0 end)::double * (ln((n + 1.0) / (d0 + 1.0)) + 1)
  + (case when list_contains(t, 'key') then 1 when contains(b, 'key') then 0.5 else 0 end)::double * (ln((n + 1.0) / (d1 + 1.0)) + 1) score from r, s)
  select listing_id, round(score, 6) score from q where score > 0 order by q.score desc, listing_id limit 100"""
)
def r_keyword_blob(spark, folder):
    """Keyword search over the whole text."""
    return search.top(search.keyword_by_blob(table(spark, folder, "laptops"), "Slate, KEY", ["name", "description"]), "listing_id", 100).select("listing_id", F.round("score", 6).alias("score"))


@query(
    _exact_sql(["rugged", "trackpad"], partial_counts=True)
    + """, p as (select min(num_reviews)::double lo, max(num_reviews)::double hi from laptops)
  select listing_id, round(score * (1 + 0.2::double * coalesce((num_reviews - lo) / greatest(hi - lo, 1), 0)), 6) score from q, p where score > 0 order by q.score * (1 + 0.2::double * coalesce((num_reviews - lo) / greatest(hi - lo, 1), 0)) desc, listing_id limit 100"""
)
def r_keyword_popularity(spark, folder):
    """Keyword search raised by popularity."""
    df = table(spark, folder, "laptops")
    found = search.keyword_by_token(df, "rugged trackpad", ["description"], count_partial=True)
    return search.top(search.with_popularity(found, df, "num_reviews"), "listing_id", 100).select("listing_id", F.round("score", 6).alias("score"))


@query("""with q as (select embedding e from embeddings where vec_id = (select min(vec_id) from embeddings)), s as (select vec_id, list_dot_product(embedding::double[], e::double[]) score from embeddings, q)
select vec_id, round(score, 6) score from s where score > 0 order by s.score desc, vec_id limit 20""")
def r_semantic_topk(spark, folder):
    """Nearest vectors of one vector."""
    df = table(spark, folder, "embeddings")
    vector = df.orderBy("vec_id").select("embedding").first()[0]
    return search.semantic(df, vector).orderBy(F.col("score").desc(), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


@query("""with s as (select q.vec_id query_id, i.vec_id item_id, list_dot_product(q.embedding::double[], i.embedding::double[]) score from embeddings q, embeddings i where q.vec_id % 20 = 0 and q.vec_id <> i.vec_id)
select query_id, item_id, round(score, 6) score, row_number() over (partition by query_id order by s.score desc, item_id) rank from s where score > 0 qualify rank <= 5""")
def r_semantic_blocks(spark, folder):
    """Nearest vectors of every twentieth vector."""
    df = table(spark, folder, "embeddings")
    out = search.semantic_pairs(df.where("vec_id % 20 = 0"), df, 5, "vec_id", "vec_id")
    return out.withColumn("score", F.round("score", 6))


@query(_exact_sql(["rugged", "battery"]).replace("from laptops)", "from laptops where price <= 900 and not isnan(price))") + " select listing_id, round(score, 6) score from q where score > 0 order by q.score desc, listing_id limit 50")
def r_prefiltered(spark, folder):
    """Search among rows that satisfy a constraint; frequencies count those rows only."""
    df = constraint_filter(table(spark, folder, "laptops"), {"p": 900}, [ConstraintSpec("p", "price", "lte")])
    return search.top(search.keyword_by_token(df, "rugged battery", ["description"]), "listing_id", 50).select("listing_id", F.round("score", 6).alias("score"))


@query("""select car_id, round(2.0::double * ((engine_hp is not null)::int + (number_of_doors is not null)::int + (market_category is not null)::int) + ln(1 + coalesce(popularity, 1)), 6) weight from cars""")
def w_anchor_weight(spark, folder):
    """Weights by completeness and popularity."""
    df = table(spark, folder, "cars")
    return df.select("car_id", F.round(scoring.anchor_weight(df, ["engine_hp", "number_of_doors", "market_category"], "popularity"), 6).alias("weight"))


@query("""select task_id, difficulty from (select task_id, difficulty, row_number() over (partition by difficulty order by h, task_id) r from
  (select task_id, difficulty, (length(task_id) * 1103515245 + 12345) % 2147483648 h from tasks group by all)) where r <= 20""")
def t_stratified_sample(spark, folder):
    """Up to 20 tasks of each tier."""
    t = table(spark, folder, "tasks").select("task_id", "difficulty").distinct()
    return policies.stratified(t, 20, F.pmod(F.length("task_id").cast("long") * 1103515245 + 12345, F.lit(2147483648))).select("task_id", "difficulty")


@query("""select case when b < 0.1 then 'first' else 'rest' end bucket, count(*) n from (select row_number() over (order by event_id)::double / count(*) over () b from events) group by 1""")
def w_running_share(spark, folder):
    """Running share over a range-sorted table: counts of hash-free buckets."""
    e = table(spark, folder, "events").select("event_id")
    total = e.agg(F.count(F.lit(1)).alias("all_"))
    # Prefix counts by blocks of the key, then within a block: no window over the whole table.
    blocks = e.withColumn("block", F.floor(F.col("event_id") / 1000))
    sums = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("k"))
    before = sums.select("block", (F.sum("k").over(Window.orderBy("block")) - F.col("k")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("event_id"))
    rows = blocks.join(before, "block").withColumn("place", place).crossJoin(F.broadcast(total))
    return rows.select(F.when(F.col("place") / F.col("all_") < 0.1, "first").otherwise("rest").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
