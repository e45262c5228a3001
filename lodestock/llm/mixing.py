"""Mixing sources to target weights along a training run.

Each source has a schedule of weights over the run, from 0 to 1, linear between its knots and constant
without any. Its integral times the budget is the source's cumulative demand of tokens. A source offers
its documents in a permuted order, again from the start when all are used, at most ``max_repeats``
times; the token at which a copy starts, put into the inverse of the cumulative demand, is the copy's
position in the run. Documents are range-sorted by position. A source can't fill its share where the
tokens that were placed are fewer than its demand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestock.llm.bpe import TOKENIZER, count_tokens
from lodestock.sources.shared import keep, small

BUCKET_ROWS = 50_000  # documents that one sort takes, about

SOURCES = (
    "mix_id string, source string, source_key string, target_weight double, max_repeats long, budget_tokens long, "
    "n_docs long, source_tokens long, demand double, fill double, knots array<struct<at: double, done: double, rate: double, slope: double>>"
)


def source_key(source: Column) -> Column:
    """The source without white space around it and in lower case."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def token_counts(docs: DataFrame, mix: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source_key, n_tokens) of the documents of sources that a mix names."""
    named = mix.select(source_key(F.col("source")).alias("source_key")).distinct()
    wanted = docs.withColumn("source_key", source_key(F.col("source"))).join(named, "source_key", "left_semi")
    keyed = wanted.select(F.struct("doc_id", "source_key").alias("key"), "text")
    return count_tokens(keyed, "key", "text", tokenizer).select("key.doc_id", "key.source_key", "n_tokens")


def curriculum(weights: dict[str, float], schedules: dict[str, list[tuple[float, float]]] | None = None) -> dict[str, list[tuple[float, float, float, float]]]:
    """Cumulative demand of each source as pieces (at, done, rate, slope), as a share of the budget.

    A schedule [(t, weight), ...] shapes when a source is used; the shares of the whole stay the target
    weights, so a schedule is scaled until its integral is the source's weight.
    """
    out = {}
    for source, weight in weights.items():
        knots = sorted((schedules or {}).get(source) or [(0.0, 1.0), (1.0, 1.0)])
        knots = [(0.0, knots[0][1]), *[k for k in knots if 0 < k[0] < 1], (1.0, knots[-1][1])]
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])) or 1.0
        pieces, done = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            scale = weight / area
            pieces.append((t0, done, w0 * scale, (w1 - w0) / (t1 - t0) * scale))
            done += (t1 - t0) * (w0 + w1) / 2 * scale
        out[source] = pieces
    return out


def length_curriculum(rows: list, strength: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """Schedules of one mix that bring sources of short documents early and those of long documents late.

    Weights go linearly from (1 - tilt) to (1 + tilt) times the target weight. Tilts follow the rank of a
    source's mean tokens a document (a source without tokens, in the middle), less their weighted mean, so
    that the weights of a mix sum to 1 at every moment; none is beyond ``strength`` (0 to 1) either way.
    """
    held = sorted((r for r in rows if r.source_tokens), key=lambda r: (r.source_tokens / r.n_docs, r.source_key))
    rank = {r.source_key: 2.0 * i / max(1, len(held) - 1) - 1.0 if len(held) > 1 else 0.0 for i, r in enumerate(held)}
    weight = {r.source_key: float(r.target_weight or 0.0) for r in rows}
    total = sum(weight.values()) or 1.0
    mean = sum(rank.get(k, 0.0) * w for k, w in weight.items()) / total
    tilt = {k: rank.get(k, 0.0) - mean for k in weight}
    most = max([1.0, *(abs(t) for t in tilt.values())])
    return {k: [(0.0, 1.0 - strength * t / most), (1.0, 1.0 + strength * t / most)] for k, t in tilt.items()}


def mix_sources(counts: DataFrame, mix: DataFrame, schedules: dict[str, dict] | Callable | None = None, max_rows: int = 100_000) -> DataFrame:
    """One row per (mix_id, source) with its tokens, demand and the share of the demand it can fill.

    ``mix`` is a control table of one row per mix and source; more than ``max_rows`` are an error. A source
    named twice in a mix (up to blanks and letter case) counts by its first spelling with summed weight.
    ``schedules`` are by mix and source key, or a function of a mix's rows such as ``length_curriculum``.
    """
    spark = counts.sparkSession
    have = counts.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    wanted = mix.select("mix_id", "source", source_key(F.col("source")).alias("source_key"), "target_weight", "max_repeats", "budget_tokens")
    wanted = wanted.groupBy("mix_id", "source_key").agg(
        F.min("source").alias("source"), F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"), F.max("budget_tokens").alias("budget_tokens")
    )
    rows = small(wanted.join(have, "source_key", "left"), max_rows, "mix targets")
    mixes = defaultdict(list)
    for r in rows:
        mixes[r.mix_id].append(r)
    out = []
    for mix_id, rs in mixes.items():
        pieces = curriculum({r.source_key: float(r.target_weight or 0.0) for r in rs}, schedules(rs) if callable(schedules) else (schedules or {}).get(mix_id))
        for r in rs:
            tokens, demand = int(r.source_tokens or 0), float(r.target_weight or 0.0) * int(r.budget_tokens or 0)
            most = int(r.max_repeats or 0) * tokens
            out.append(
                (mix_id, r.source, r.source_key, r.target_weight, int(r.max_repeats or 0), int(r.budget_tokens or 0), int(r.n_docs or 0), tokens, demand,
                 min(1.0, most / demand) if demand > 0 else 1.0, pieces[r.source_key])
            )
    return spark.createDataFrame(out, SOURCES)


def _ordered(counts: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(source_key, doc_id, n_tokens, start): tokens of the source before each document in a permuted order.

    Prefix sums over hash buckets, then within a bucket: no source is ordered by one task. The number of
    buckets follows the source's documents.
    """
    buckets = sources.groupBy("source_key").agg(F.ceil((F.max("n_docs") + 1) / F.lit(BUCKET_ROWS)).cast("long").alias("buckets"))
    rows = counts.where("n_tokens > 0").join(F.broadcast(buckets), "source_key").withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    rows = rows.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 33) * F.col("buckets"), 31)).drop("buckets")
    w = Window.partitionBy("source_key").orderBy("bucket")
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("source_key", "bucket", (F.sum("n").over(w) - F.col("n")).alias("before"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, ["source_key", "bucket"]).select(
        "source_key", "doc_id", "n_tokens", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")
    )


def _position(share: Column, knots: Column) -> Column:
    """Where in the run a source has had ``share`` of the budget: the inverse of its piecewise quadratic demand."""
    piece = F.element_at(F.filter(knots, lambda k: (k["done"] <= share) & ((k["rate"] > 0) | (k["slope"] > 0))), -1)
    gone = share - piece["done"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["rate"] * piece["rate"] + F.lit(2.0) * piece["slope"] * gone))
    # The form without cancellation also holds for a slope of 0.
    step = F.when(gone <= 0, 0.0).otherwise(F.lit(2.0) * gone / (piece["rate"] + root))
    return F.least(F.lit(1.0), piece["at"] + step)


def assign(counts: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_id, source, doc_id, copy, n_tokens, position) of every copy that goes into a mix, sorted by position.

    A source's copies go on until one starts at or beyond its demand, or all documents were used
    ``max_repeats`` times. Documents without tokens are left out. A source that can't fill its share
    spreads what it has over the whole run. ``copy`` counts from 1.
    """
    wanted = sources.where("demand > 0 and source_tokens > 0").select(
        "mix_id", "source", "source_key", "max_repeats", "budget_tokens", "source_tokens", "demand", "fill", "knots"
    )
    docs = _ordered(counts, sources, seed).join(F.broadcast(wanted), "source_key")  # mix_sources bounds the table
    # Whole numbers: a copy starts before the demand exactly if it starts before the next whole token.
    passes = F.expr("(ceil(demand) - start + source_tokens - 1) div source_tokens")
    docs = docs.withColumn("copies", F.least("max_repeats", passes)).where("copies > 0")
    copies = docs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    at = F.col("start") + (F.col("copy") - 1) * F.col("source_tokens")
    share = at / F.col("budget_tokens") / F.col("fill")
    return copies.select("mix_id", "source", "doc_id", "copy", "n_tokens", _position(share, F.col("knots")).alias("position")).orderBy(
        "mix_id", "position", "source", "copy", "doc_id"
    )


def report(sources: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per (mix_id, source): target and actual share and tokens, copies, most copies of one document, shortfall in tokens."""
    used = assigned.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max("copy").alias("most_copies"))
    w = Window.partitionBy("mix_id")
    tokens = F.coalesce("tokens", F.lit(0))
    return sources.join(used, ["mix_id", "source"], "left").select(
        "mix_id",
        "source",
        "target_weight",
        "max_repeats",
        "budget_tokens",
        "source_tokens",
        tokens.alias("tokens"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (tokens / F.nullif(F.sum(tokens).over(w), F.lit(0))).alias("actual_share"),
        F.greatest(F.lit(0.0), F.col("demand") - tokens).alias("shortfall_tokens"),
        (tokens < F.col("demand")).alias("cannot_fill"),
    )


def mixed(docs: DataFrame, mix: DataFrame, *, tokenizer: str = TOKENIZER, schedules: dict | Callable | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sources with their demand, assigned copies). Tokens are counted once, over whole texts of all named sources."""
    counts = keep(token_counts(docs, mix, tokenizer), "mix-tokens")
    sources = mix_sources(counts, mix, schedules)
    return sources, assign(counts, sources, seed)
