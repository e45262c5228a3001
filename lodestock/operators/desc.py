"""Attributes read from descriptions: a long table (pid, attr, value) normalised, measured and clustered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestock.fixed import EMPTY_DESCRIPTIONS


def usable(df: DataFrame, text: str) -> DataFrame:
    """Rows with a text that says something."""
    t = F.lower(F.trim(F.col(text)))
    return df.where((F.length(t) > 0) & ~t.isin(*EMPTY_DESCRIPTIONS))


def canonical_first(long: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """(pid, attr, value) with canonical names; of several raw keys with one name the first value by ``order`` stands."""
    named = long.join(mapping, long["attr"] == mapping["raw"]).select("pid", F.col("canonical").alias("attr"), "value", F.col(order).alias("_o"))
    return named.groupBy("pid", "attr").agg(F.min_by("value", F.struct("_o", "value")).alias("value"))


def key_tiers(long: DataFrame, share: float = 0.95) -> DataFrame:
    """(attr, n, tier): tier 1 holds the most frequent keys until ``share`` of all values is covered, the crossing key included."""
    n = long.groupBy("attr").agg(F.count(F.lit(1)).alias("n"))
    # Keys of one count stand together: their sums are few rows, and only keys of the count in which the share is
    # reached need an order among themselves.
    sizes = n.groupBy("n").agg((F.count(F.lit(1)) * F.col("n")).alias("own"))
    w = Window.orderBy(F.col("n").desc())
    placed = sizes.withColumns({"upto": F.sum("own").over(w), "all_": F.sum("own").over(Window.partitionBy(F.lit(0)))}).withColumn("before", F.col("upto") - F.col("own"))
    need = F.lit(share) * F.col("all_")
    rows = n.join(placed, "n")
    apart = rows.where((F.col("before") >= need) | (F.col("upto") <= need)).select("attr", "n", F.when(F.col("before") < need, 1).otherwise(2).alias("tier"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("attr")) - 1
    crossing = rows.where((F.col("before") < need) & (F.col("upto") > need)).select("attr", "n", F.when(F.col("before") + place * F.col("n") < need, 1).otherwise(2).alias("tier"))
    return apart.unionByName(crossing)


def key_samples(long: DataFrame, k: int = 12) -> DataFrame:
    """(attr, n, samples): up to ``k`` distinct values of each key, the least ones, without collecting whole groups."""
    values = long.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("attr").orderBy("value")
    few = values.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("attr").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return values.groupBy("attr").agg(F.sum("n").alias("n")).join(few, "attr")


def attribute_coverage(long: DataFrame, n_products: int, top: int = 15, least: float = 0.05, most: float = 0.95) -> DataFrame:
    """Per attribute: products, share of all products, type by its values, distinct values, dominance, passes.

    boolean if all values are true or false, numeric if all are numbers, else categorical. Dominance is the
    share of the most frequent value; an attribute passes with enough coverage and without a dominating value.
    """
    v = F.lower(F.trim("value"))
    per = long.groupBy("attr", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    stats = per.groupBy("attr").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("top_n"), F.min(F.struct(-F.col("n"), F.col("v")))["v"].alias("top_value"),
        F.bool_and(F.col("v").isin("true", "false")).alias("flag"), F.bool_and(F.col("v").try_cast("double").isNotNull()).alias("numeric"),
    )
    share = F.col("n") / F.lit(float(max(n_products, 1)))
    return stats.select(
        "attr", "n", share.alias("coverage"), F.when(F.col("flag"), "boolean").when(F.col("numeric"), "numeric").otherwise("categorical").alias("attr_type"),
        "n_distinct", "top_value", (F.col("top_n") / F.col("n")).alias("dominance"), ((share >= least) & (F.col("top_n") / F.col("n") <= most)).alias("passes"),
    )


def attribute_values(long: DataFrame, top: int = 15) -> DataFrame:
    """(attr, value, n): the ``top`` values of each attribute."""
    per = long.groupBy("attr", F.lower(F.trim("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("attr").orderBy(F.col("n").desc(), "value")
    return per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def representatives(vectors: DataFrame, k: int, id_column: str, embedding: str = "embedding", seeds: int = 10, batches: int = 1) -> DataFrame:
    """(id, batch): the rows nearest to the centroids of the best of several k-means runs (by inertia), each once.

    Null and zero vectors are left out; fewer rows than k give fewer clusters. Batches are equal runs of
    representatives in the order of their clusters, the last takes the rest.
    k is small by use (prompt examples) and checked: centroids are held by the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    if not 1 <= batches <= k <= 1000:
        raise ValueError("k must lie between 1 and 1000 and batches between 1 and k")
    rows = vectors.where(F.col(embedding).isNotNull()).select(id_column, F.transform(embedding, lambda x: x.cast("double")).alias("_v"))
    feats = rows.where(F.exists("_v", lambda x: x != 0)).withColumn("features", array_to_vector("_v")).cache()
    k = min(k, feats.count())
    if not k:
        return feats.select(id_column, F.lit(0).alias("batch"))
    if k == 1:  # KMeans takes two clusters or more
        centers = [feats.agg(Summarizer.mean(F.col("features"))).first()[0].toArray()]
    else:
        centers = min((KMeans(k=k, seed=42 + s).fit(feats) for s in range(seeds)), key=lambda m: m.summary.trainingCost).clusterCenters()
    near = []
    for center in centers:
        d = F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(x)) for x in center]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        near.append(F.min(F.struct(d.alias("d"), F.col(id_column).alias("id"))))
    ids = feats.agg(F.array(*near).alias("n")).select(F.array_distinct(F.transform("n", lambda x: x["id"])).alias("ids"))
    each = F.greatest(F.floor(F.size("ids") / batches), F.lit(1))
    return ids.select(each.alias("_each"), F.posexplode("ids").alias("_at", id_column)).select(
        id_column, F.least(F.floor(F.col("_at") / F.col("_each")), F.lit(batches - 1)).cast("int").alias("batch")
    )


def embedding_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """With ``text``: one ``name: value`` line for each column that has a value."""
    lines = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in columns]
    return df.withColumn("text", F.concat_ws("\n", *lines))


def positional(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(pid, payload): answers matched by id first, the rest in order of position. Both have pos; ids may be null."""
    by_id = expected.join(returned.where("pid is not null").dropDuplicates(["pid"]).select("pid", "payload"), "pid")
    rest = expected.join(by_id.select("pid"), "pid", "left_anti")
    spare = returned.join(expected.select("pid"), "pid", "left_anti")
    w = Window.orderBy("pos")  # one prompt's rows
    a = rest.withColumn("_r", F.row_number().over(w))
    b = spare.withColumn("_r", F.row_number().over(w)).select("_r", "payload")
    return by_id.select("pid", "payload").unionByName(a.join(b, "_r").select("pid", "payload"))


