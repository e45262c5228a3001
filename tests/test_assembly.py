"""Assembly, validation and providers."""

import json

import pytest
from pyspark.sql import functions as F

from lodestock.model import ConstraintSpec, Domain, Preference, Trigger
from lodestock.operators import assembly as A
from lodestock.operators import explore, scoring


def test_preference_problems(spark):
    schema = "id int, p array<struct<attribute: string, direction: string, target: string, priority: int, revelation_mode: string, trigger: string>>"
    good = [("price", "minimize", None, 1, "responsive", "t"), ("word", "match", "x", 2, "contextual", "t")]
    bad = [("price", "up", None, 1, "responsive", "t"), ("price", "match", None, 3, "never", "t")]
    got = {r.id: r.v for r in spark.createDataFrame([(1, good), (2, bad), (3, []), (4, None)], schema).select("id", A.preference_problems(F.col("p")).alias("v")).collect()}
    assert got == {1: [], 2: ["direction", "no_target", "mode", "repeated", "priorities"], 3: ["empty"], 4: ["empty"]}


def test_assembled_tasks(spark):
    pools = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, "c", 9.0), (2, "d", 1.0)], "task_id int, pid string, price double")
    prefs = [Preference("price", "minimize", priority=1)]
    ranked = scoring.ranked(scoring.score_pool(pools, prefs, ["task_id"]), "pid", ["task_id"])
    out = {r.task_id: r for r in A.assemble(pools.select("task_id").distinct(), ranked, scoring.pool_stats(pools, prefs, ["task_id"]), prefs).collect()}
    assert out[1].best_product_ids == ["a", "b"] and out[1].pool_size == 3 and out[1].price_max == 9.0 and out[1].preference_weights == [1.0] and out[2].best_utility == 1.0


def test_merging_and_triggers():
    merged = A.merged_preferences([Preference("b", priority=2), Preference("a", priority=1)], [Preference("c")], [Trigger("t1", ["c"]), Trigger("t2", ["c"])])
    assert [(p.attribute, p.priority, p.trigger) for p in merged] == [("a", 1, None), ("b", 2, None), ("c", 3, "t1")]
    d = Domain("d", "id", constraints=[ConstraintSpec("m", "price", "lte"), ConstraintSpec("x", "text", "substring", desc_constraint=True)])
    assert [t[:2] for t in A.violation_triggers(d)] == [("shown_wrong_m", "m")]


def test_providers(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.embedding for r in A.embedded(df, "text", lambda texts: [[float(len(t))] for t in texts], "id", batch=2).collect()}
    assert got == {1: [2.0], 2: [], 3: []}
    answers = iter(["no", '```json\n{"a": 1}\n```'])
    assert A.parsed_json(lambda p: next(answers), "x") == {"a": 1}
    with pytest.raises(ValueError):
        A.parsed_json(lambda p: "no", "x", tries=2)
    log = tmp_path / "calls.jsonl"
    assert A.CallLog(str(log))(lambda x: x + 1)(1) == 2 and "seconds" in json.loads(log.read_text())
    assert A.filled("{a} {b}", {"a": "1"}) == "1 {b}"
    with pytest.raises(ValueError):
        A.manifest(str(tmp_path))
    (tmp_path / "manifest.json").write_text('{"name": "My Shop", "id_column": "id"}')
    assert A.manifest(str(tmp_path))["alias"] == "my_shop"


def test_lines_and_similar_values(spark):
    df = spark.createDataFrame([(1, "Red", 90, None), (2, None, 5, "x"), (3, "Reed", None, "x")], "id int, word string, minutes int, tag string")
    lines = [r.l for r in df.orderBy("id").select(A.one_line({"": F.col("word"), "plays": A.duration(F.col("minutes")), "tag": F.col("tag")}).alias("l")).collect()]
    assert lines == ["Red | plays: 1.5 h", "plays: 5 min | tag: x", "Reed | tag: x"]
    assert [r.value for r in explore.list_values_similar(df, "word", "red").collect()] == ["Red", "Reed"]
