"""Keyword and vector search over a catalogue.

Document frequencies are exact counts over the rows searched (after any filter), in one aggregate; the
query is a plan-time list of tokens in which a repeated token weighs twice.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestock.functions.text import blob, dot, tokens
from lodestock.operators.scoring import boosted


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", query.lower()) if len(t) >= 2]


def _idf(df: Column, n: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def _score(rows: DataFrame, words: list[str], exact, partial, counted) -> DataFrame:
    """rows with ``score``: each word's IDF where it is exact, half of it where it is partial, times its repeats."""
    many = Counter(words)
    names = sorted(many)
    stats = rows.agg(F.count(F.lit(1)).alias("n_"), *[F.count_if(counted(w)).alias(f"df_{i}") for i, w in enumerate(names)])
    joined = rows.crossJoin(F.broadcast(stats))  # an aggregate without keys is one row
    total = F.lit(0.0)
    for i, w in enumerate(names):
        idf = _idf(F.col(f"df_{i}"), F.col("n_"))
        total = total + F.lit(float(many[w])) * F.when(exact(w), idf).when(partial(w), idf * 0.5).otherwise(0.0)
    return joined.withColumn("score", total).drop("n_", *[f"df_{i}" for i in range(len(names))])


def keyword_by_token(df: DataFrame, query: str, columns: list[str], *, count_partial: bool = False) -> DataFrame:
    """Rows that match the query with ``score``: whole tokens count in full, tokens that hold or lie in a query token half.

    ``count_partial`` also counts partial matches as document frequency. Rows without a match are left out;
    an empty query or no known column gives no row. Null cells hold no tokens.
    """
    words, known = query_tokens(query), [c for c in columns if c in df.columns]
    if not words or not known:
        return df.limit(0).withColumn("score", F.lit(0.0))
    rows = df.withColumn("_tokens", F.array_distinct(tokens(blob(*[_text(df, c) for c in known]))))
    exact = lambda w: F.array_contains("_tokens", w)
    partial = lambda w: F.exists("_tokens", lambda t: F.contains(t, F.lit(w)) | F.contains(F.lit(w), t))
    counted = (lambda w: exact(w) | partial(w)) if count_partial else exact
    return _score(rows, words, exact, partial, counted).drop("_tokens").where("score > 0")


def keyword_by_blob(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """As above over the whole text: whole tokens count in full, other places where the token stands half; both count as frequency."""
    words, known = query_tokens(query), [c for c in columns if c in df.columns]
    if not words or not known:
        return df.limit(0).withColumn("score", F.lit(0.0))
    text = F.lower(blob(*[_text(df, c) for c in known]))
    rows = df.withColumns({"_blob": text, "_tokens": tokens(text)})
    exact = lambda w: F.array_contains("_tokens", w)
    held = lambda w: F.contains(F.col("_blob"), F.lit(w))
    return _score(rows, words, exact, held, held).drop("_tokens", "_blob").where("score > 0")


def _text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.concat_ws(" ", c.cast("array<string>")) if dict(df.dtypes)[name].startswith("array") else c.cast("string")


def with_popularity(scored: DataFrame, catalog: DataFrame, popularity: str) -> DataFrame:
    """Scores raised by popularity, scaled over the whole catalogue."""
    p = F.col(popularity).cast("double")
    span = catalog.agg(F.min(p).alias("lo_"), F.max(p).alias("hi_"))
    return scored.crossJoin(F.broadcast(span)).withColumn("score", boosted(F.col("score"), p, F.col("lo_"), F.col("hi_"))).drop("lo_", "hi_")


def top(scored: DataFrame, id_column: str, k: int = 10) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), F.col(id_column)).limit(k)


def semantic(df: DataFrame, vector: list[float], embedding: str = "embedding") -> DataFrame:
    """Rows with ``score`` = inner product with the query vector, above 0; null and zero vectors match nothing."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return df.withColumn("score", dot(F.col(embedding), query)).where("score > 0")


def semantic_pairs(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, embedding: str = "embedding", max_queries: int = 10_000) -> DataFrame:
    """Top ``k`` items of each query vector. Queries are broadcast, in blocks by hash of about ``max_queries``."""
    from pyspark.sql import Window

    q = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("_q"))
    v = items.select(F.col(item_id).alias("item_id"), F.col(embedding).alias("_v"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    found = []
    for block in hash_blocks(q, max_queries, "query_id"):
        scored = v.crossJoin(F.broadcast(block))
        scored = scored.select("query_id", "item_id", dot(F.col("_q"), F.col("_v")).alias("score")).where("score > 0 and query_id <> item_id")
        found.append(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionByName, found)


def hash_blocks(df: DataFrame, size: int, *keys: str) -> list[DataFrame]:
    """The rows in blocks of about ``size`` by hash of the keys, small enough to be broadcast; rows of one key stay together."""
    n = max(1, -(-df.count() // size))
    block = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [df.where(block == i) for i in range(n)] if n > 1 else [df]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
