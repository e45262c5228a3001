"""Frequency of every distinct value and term, by recursive radix partitioning.

1. Cells are reduced to (field, value, record) counts, so a value or a record that holds a third of
   all rows is small before anything is split into terms.
2. Terms are partitioned by the first bits of their hash. A histogram shows which of these cells hold
   more than ``task_rows``, or more than a quarter of an even share of a task; they are split by the next bits, and what is still too large (in effect one
   hot term) by bits of the record's hash, since counts of distinct records add up over disjoint sets.
3. The shuffle brings each leaf of that radix tree to one task, leaf after leaf. A task feeds DuckDB until
   it holds about ``task_rows``, aggregates them and goes on: what it holds doesn't grow with its input.
4. The leaves' partial counts are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.llm.duck import run as execute, task_db
from lodestock.sources.shared import keep, shared_root, small

BITS = 12
TERM = r"[\p{L}\p{N}]+"  # fixed form: a run of letters and digits (Unicode categories L and N)
PARTIAL = "field string, kind string, term string, occurrences long, records long"


def _aggregate(shared: str, task_rows: int):
    """A task: rows sorted by leaf in, partial counts of their terms out."""

    def counted(con) -> Iterator[pa.RecordBatch]:
        found = con.sql(
            """select field, kind, term, sum(n)::bigint occurrences, count(record)::bigint records
               from (select field, kind, term, record, sum(n) n from cells group by all) group by all"""
        ).to_arrow_table()
        execute(con, "truncate cells")
        yield from found.cast(SCHEMA).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_db(shared) as con:
            execute(con, "create temp table cells (field varchar, kind varchar, term varchar, record varchar, n bigint)")
            held, last = 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                leaves = batch.column(0).to_numpy()
                # A leaf isn't torn, else its records would count twice: cut only where the leaf changes.
                cuts = [0, *(np.flatnonzero(leaves[1:] != leaves[:-1]) + 1).tolist(), len(leaves)]
                at = 0
                for a, b in zip(cuts, cuts[1:]):
                    if leaves[a] != last and held + a - at >= task_rows:
                        _feed(con, batch.slice(at, a - at))
                        yield from counted(con)
                        held, at = 0, a
                    last = leaves[a]
                held += _feed(con, batch.slice(at))
                if held > 2 * task_rows:  # many rows of few terms and records
                    execute(con, "create or replace temp table less as select field, kind, term, record, sum(n)::bigint n from cells group by all")
                    execute(con, "truncate cells")
                    execute(con, "insert into cells from less")
                    execute(con, "drop table less")
                    held = execute(con, "select count(*) from cells")[0][0]
            if held:
                yield from counted(con)

    return run


def _feed(con, batch: pa.RecordBatch) -> int:
    """Add the rows to the table, each (term, record) of the batch once; how many there were."""
    if not batch.num_rows:
        return 0
    con.register("b", pa.Table.from_batches([batch]))
    n = execute(con, "insert into cells select field, kind, term, record, sum(n)::bigint from b group by all")[0][0]
    con.unregister("b")
    return n


SCHEMA = pa.schema([("field", pa.string()), ("kind", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def term_frequencies(
    df: DataFrame,
    fields: list[str],
    record: str,
    *,
    min_records: int = 3,
    max_share: float = 0.40,
    task_rows: int = 500_000,
) -> DataFrame:
    """One row per (field, kind, term): occurrences, records, all_records, too_rare, too_common.

    ``kind`` is ``value`` (the cell as stored) or ``term`` (a run of letters and digits of the
    lower-cased cell). ``occurrences`` counts over all rows, a term as often as it stands in the cell;
    ``records`` counts distinct non-null ``record``; ``all_records`` the distinct records with a
    non-null value in the field. Rare: in fewer than ``min_records``; common: in more than
    ``max_share`` of ``all_records``. Null cells count nowhere; empty and blank cells are values
    without terms; rows without a record count as occurrences only. An empty table gives no row.
    """
    spark = df.sparkSession
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    base = (
        df.select(F.col(f"`{record}`").cast("string").alias("record"), cells.alias("c"))
        .select("record", "c.field", "c.value")
        .where("value is not null")
        .groupBy("field", "value", "record")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    base = keep(base, "terms")

    values = base.select("field", F.lit("value").alias("kind"), F.col("value").alias("term"), "record", "n")
    terms = base.select(
        "field", F.lit("term").alias("kind"), F.explode(F.expr(f"regexp_extract_all(lower(value), r'{TERM}', 0)")).alias("term"), "record", "n"
    )
    rows = values.unionByName(terms).withColumn("h", F.xxhash64("field", "kind", "term"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - BITS))
    sizes = {r.cell: r.n for r in small(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), 1 << BITS, "cells")}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // (8 * task_rows)))
    limit = max(1, min(task_rows, sum(sizes.values()) // (4 * parts)))  # no leaf is much of a task either
    below = F.shiftrightunsigned("h", 64 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    large = sorted(c for c, n in sizes.items() if n > limit)
    if large:  # at most 2**BITS cells
        split = spark.createDataFrame([(c,) for c in large], "cell long")
        inner = rows.join(F.broadcast(split), "cell").withColumn("sub", below).groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("n"))
        # At most one row per limit rows of the input.
        hot = inner.where(F.col("n") > limit).select("cell", "sub", F.ceil(F.col("n") / limit).cast("long").alias("splits"))
        rows = rows.join(F.broadcast(split.withColumn("split", F.lit(True))), "cell", "left").withColumn("sub", F.when(F.col("split"), below).otherwise(F.lit(0)))
        rows = rows.join(F.broadcast(keep(hot, "hot-terms")), ["cell", "sub"], "left")
        part = F.pmod(F.xxhash64("record"), F.coalesce("splits", F.lit(1)))
        leaves = rows.withColumn("leaf", F.xxhash64("cell", "sub", part))
    else:
        leaves = rows.withColumnRenamed("cell", "leaf")
    sent = leaves.select("leaf", "field", "kind", "term", "record", "n").repartition(parts, "leaf").sortWithinPartitions("leaf")
    partial = sent.mapInArrow(_aggregate(shared_root(spark), task_rows), PARTIAL)
    total = base.where("record is not null").groupBy("field", "record").count().groupBy("field").agg(F.count(F.lit(1)).alias("all_records"))
    return (
        partial.groupBy("field", "kind", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .join(F.broadcast(total), "field", "left")
        .withColumn("all_records", F.coalesce("all_records", F.lit(0)))
        .withColumn("too_rare", F.col("records") < min_records)
        .withColumn("too_common", F.col("records") > F.lit(float(max_share)) * F.col("all_records"))
    )
