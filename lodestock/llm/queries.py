"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm import canonical, frequency, mixing, sampling, spans
from lodestock.llm.bpe import TOKENIZER, encode_texts
from lodestock.sources.shared import keep
from lodestock.sources.tables import table

TYPED = ("processor", "gpu_type")


def tokenizer(spark: SparkSession) -> str:
    """File of the tokenizer, the same path on every executor: the session's ``spark.lodestock.tokenizer`` where it is set."""
    return spark.conf.get("spark.lodestock.tokenizer", TOKENIZER)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the tasks of the plan's domain cannot meet: the draw to the target ended before it."""
    quotas, ranks, _ = _drawn(spark, folder)
    return sampling.unmet(quotas, ranks).select("plan_id", "category")


def _drawn(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allocation, ranks of the tasks drawn, sample)."""
    tasks, targets = table(spark, folder, "tasks"), table(spark, folder, "sampling_targets")
    candidates = keep(sampling.plan_candidates(tasks, targets), "candidates")
    quotas = sampling.allocation(tasks, targets, candidates=candidates)
    ranks = keep(sampling.ranked(candidates, quotas), "ranked")
    return quotas, ranks, keep(sampling.draw(candidates, quotas, ranks=ranks), "sample")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The tasks drawn for each plan."""
    return _drawn(spark, folder)[2]


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each category with its target, actual share and shortfall."""
    quotas, _, sample = _drawn(spark, folder)
    return sampling.report(quotas, sample)


def p1_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per plan: tasks that belong to a category, tasks drawn, different ones among them."""
    quotas, _, sample = _drawn(spark, folder)
    size = quotas.groupBy("plan_id").agg(F.max("sample_size").alias("sample_size"), F.sum("capacity").alias("tasks"))
    drawn = sample.groupBy("plan_id").agg(F.count(F.lit(1)).alias("drawn"), F.countDistinct("task_id").alias("different"))
    return size.join(drawn, "plan_id", "left").select("plan_id", "sample_size", "tasks", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("different", F.lit(0)).alias("different"))


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, folder, "laptops"), list(TYPED), "product_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to filter on."""
    return _frequencies(spark, folder).where("kind = 'term' and (too_rare or too_common)").select("field", "term")


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct value and term with its counts."""
    return _frequencies(spark, folder)


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    laptops = table(spark, folder, "laptops")
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in TYPED]))
    return laptops.select("listing_id", cells.alias("c")).select("listing_id", "c.*").where(r"value is not null and not value rlike '(?U)^\\s*$'")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entry meant by each value that isn't exactly a label, 0 if none is."""
    rows, entries = _typed(spark, folder), table(spark, folder, "canonical_values")
    labels = entries.select("attribute", F.col("label").alias("value"))
    mapped = keep(canonical.map_values(rows, entries).join(labels, ["attribute", "value"], "left_anti"), "mapped")
    total = mapped.agg(F.sum("occurrences")).first()[0] or 0
    return canonical.attach(rows.join(labels, ["attribute", "value"], "left_anti"), mapped, total).select("listing_id", "attribute", "canon_id")


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values that mean no entry, with the best score and how many listings have them."""
    mapped = canonical.map_values(_typed(spark, folder), table(spark, folder, "canonical_values"))
    return mapped.where("canon_id = 0").withColumnRenamed("occurrences", "listings")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, folder, "documents"), tokenizer=tokenizer(spark))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sources, assigned copies) of all mixes, each with the schedules of ``mixing.length_curriculum``."""
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), tokenizer=tokenizer(spark), schedules=mixing.length_curriculum)


def _placed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # The assignment is written, else the optimiser leaves out whatever of it a report doesn't select.
    sources, assigned = _mixed(spark, folder)
    return sources, keep(assigned, "assigned")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of a mix that cannot fill their share: fewer tokens were placed than it demands."""
    return mixing.report(*_placed(spark, folder)).where("cannot_fill").select("mix_id", "source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of every source of every mix."""
    return mixing.report(*_placed(spark, folder))


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of every document in a mix, in training order."""
    return _mixed(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a common span of 150 characters or more."""
    return spans.span_pairs(*spans.shared_spans(table(spark, folder, "documents")))


def p8_links(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of classes of equal texts with a common span, with the number of common stretches and the longest."""
    return spans.class_links(*spans.shared_spans(table(spark, folder, "documents")))


def p8_members(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document that can hold a span, with the number of its copies and of the classes it shares spans with."""
    return spans.span_members(*spans.shared_spans(table(spark, folder, "documents")))


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document stands in others."""
    docs = table(spark, folder, "documents")
    return spans.span_coverage(*spans.shared_spans(docs), docs)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_sample, p1_report, p1_totals, p2_found, p2_frequencies, p5_found, p5_unmatched, p6_ids, p7_found, p7_report, p7_order, p8_found, p8_links, p8_members, p8_coverage,
    )
}

_TERMS = """select '{0}' field, product_id, {0} value, unnest(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')) term from laptops where {0} is not null"""

ORACLES = {
    "p1_found": r"""
with t as (select t.plan_id, t.category, t.target_share, t.min_tasks, t.sample_size, k.task_id
  from sampling_targets t left join (select distinct p.plan_id, x.task_id, map_extract(x.user_profile.hard_constraints, p.constraint_name)[1] v
    from tasks x join (select distinct plan_id, domain, constraint_name from sampling_targets) p using (domain)) k
  on k.plan_id = t.plan_id and (case when t.category = '(absent)' then k.v is null else lower(trim(k.v)) = lower(trim(t.category)) end))
select plan_id, category from t group by plan_id, category, target_share, min_tasks, sample_size
having count(distinct task_id) < min_tasks or count(distinct task_id) < target_share * sample_size""",
    "p1_totals": r"""
with c as (select distinct p.plan_id, p.category, p.sample_size, x.task_id from sampling_targets p left join tasks x
  on x.domain = p.domain and x.task_id is not null and (case when p.category = '(absent)' then map_extract(x.user_profile.hard_constraints, p.constraint_name)[1] is null
     else lower(trim(map_extract(x.user_profile.hard_constraints, p.constraint_name)[1])) = lower(trim(p.category)) end))
select plan_id, max(sample_size) sample_size, count(distinct task_id) tasks, least(max(sample_size), count(distinct task_id)) drawn,
  least(max(sample_size), count(distinct task_id)) different from c group by 1""",
    "p2_found": f"""
with terms as ({" union all ".join(_TERMS.format(f) for f in TYPED)}),
n as ({" union all ".join(f"select '{f}' field, count(distinct product_id) n from laptops where {f} is not null" for f in TYPED)})
select field, term from terms join n using (field) group by field, term, n
having count(distinct product_id) < 3 or count(distinct product_id) > 0.40 * n""",
    # All windows of all texts, as they stand.
    "p8_found": """
with t as materialized (select doc_id, text, length(text) n from documents where length(text) >= 150),
c as materialized (select doc_id, substring(text, 1 + (k - 1) * 2000, 2149) chunk from t, unnest(range(1, 2 + n // 2000)) u(k)),
w as materialized (select doc_id, substring(chunk, i::bigint, 150) span from c, unnest(range(1, least(2000, length(chunk) - 149) + 1)) u(i)),
s as materialized (select span from w group by span having min(doc_id) < max(doc_id)),
m as materialized (select distinct span, doc_id from w semi join s using (span))
select distinct a.doc_id doc_a, b.doc_id doc_b from m a join m b on a.span = b.span and a.doc_id < b.doc_id""",
    "p2_frequencies": f"""
with terms as ({" union all ".join(_TERMS.format(f) for f in TYPED)}),
cells as ({" union all ".join(f"select '{f}' field, product_id, {f} term from laptops where {f} is not null" for f in TYPED)}),
n as (select field, count(distinct product_id) all_records from cells group by 1),
c as (select field, 'term' kind, term, count(*) occurrences, count(distinct product_id) records from terms group by all
  union all select field, 'value', term, count(*), count(distinct product_id) from cells group by all)
select c.*, all_records, records < 3 too_rare, records > 0.40 * all_records too_common from c join n using (field)""",
}
