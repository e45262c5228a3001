import os
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lodestock.llm import duck
from lodestock.llm.frequency import _aggregate, term_frequencies


@pytest.mark.parametrize("task_rows", [2_000_000, 20])
def test_against_counting(spark, task_rows):
    words = ["Red fox", "RED  fox-2", "é９ red", "", " ", None, "--", "red red"]
    rows = [(words[i % 8], None if i % 11 == 0 else f"p{i % 5 if i % 3 else 0}", "x") for i in range(200)]
    rows.append(("x" * 50_000, "p9", "y"))
    df = spark.createDataFrame(rows, "v string, rec string, term string")
    got = {(r.kind, r.term): r for r in term_frequencies(df, ["v"], "rec", task_rows=task_rows).collect()}
    occ, recs, have = Counter(), defaultdict(set), set()
    for v, r, _ in rows:
        if v is None:
            continue
        have.add(r)
        occ["value", v] += 1
        recs["value", v].add(r)
        for t in re.findall(r"[^\W_]+", v.lower()):
            occ["term", t] += 1
            recs["term", t].add(r)
    assert set(got) == set(occ)
    for k, n in occ.items():
        true = len(recs[k] - {None})
        assert (got[k].occurrences, got[k].records) == (n, true)
        assert got[k].too_rare == (true < 3) and got[k].too_common == (true > 0.4 * len(have - {None}))


def test_empty(spark):
    df = spark.createDataFrame([], "v string, rec string")
    assert term_frequencies(df, ["v"], "rec").count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "v string, rec string")
    assert term_frequencies(nulls, ["v"], "rec").count() == 0


def test_nothing_is_written_where_only_one_machine_sees_it(tmp_path, monkeypatch):
    """With a shared folder that DuckDB can't write to, it doesn't spill to the worker's current folder either."""
    monkeypatch.chdir(tmp_path)
    rows = 60_000
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([k // 10] * 1000), pa.array(["f"] * 1000), pa.array(["term"] * 1000), pa.array([f"{k % 10}-{i}" * 20 for i in range(1000)]), pa.array([f"p{i}" * 9 for i in range(1000)]), pa.array([1] * 1000)],
            ["leaf", "field", "kind", "term", "record", "n"],
        )
        for k in range(rows // 1000)
    ]
    out = [b for b in _aggregate("hdfs://name/shared", 5_000)(iter(batches))]
    assert sum(b.num_rows for b in out) == rows and not os.listdir(tmp_path)
    assert task_db_setting() == ""


def task_db_setting():
    with duck.task_db("hdfs://name/shared") as con:
        return con.execute("select current_setting('temp_directory')").fetchall()[0][0]


def test_leaves_are_whole_whatever_the_batches(spark):
    """Leaves that lie across batches, and many rows of one term and record, count once."""
    rows = [(leaf, "f", "term", f"t{leaf}", f"r{i % 3}", 2) for leaf in range(40) for i in range(50)]
    for size in (7, 33, 2000):
        cuts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cut)], ["leaf", "field", "kind", "term", "record", "n"]) for cut in cuts]
        out = [r for b in _aggregate("", 60)(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["term"], r["occurrences"], r["records"]) for r in out) == sorted((f"t{i}", 100, 3) for i in range(40))
