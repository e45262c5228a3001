"""Lines, tables and rules that are shown or read."""

import pytest
from pyspark.sql import functions as F

from lodestock.operators import reports
from lodestock.operators.configgen import coherent
from lodestock.operators.profile import ColumnProfile


def test_constraint_lines(spark):
    df = spark.createDataFrame([(1, {"ram": "16", "brand": None}, {"ram": "reactive"}, {"ram": "shown_less"}), (2, None, None, None), (3, {}, {}, {})], "id int, c map<string,string>, m map<string,string>, t map<string,string>")
    got = {r.id: r.x for r in df.select("id", reports.constraint_lines(F.col("c"), F.col("m"), F.col("t")).alias("x")).collect()}
    assert got == {1: ["- brand:   [responsive]", "- ram: 16  [reactive: shown_less]"], 2: [], 3: []}


def test_tables(spark):
    results = spark.createDataFrame([("t1", "hard", 0.5), ("t2", "easy", 1.0), ("t3", "easy", None), ("t4", None, 0.0)], "task_id string, difficulty string, ndcg double")
    got = {r.difficulty: (r.n, r.ndcg) for r in reports.ranking_table(results, ["ndcg"]).collect()}
    assert got == {"overall": (4, 0.5), "easy": (2, 1.0), "hard": (1, 0.5), "(none)": (1, 0.0)}
    text = reports.as_text(reports.ranking_table(results, ["ndcg"]), "Ranking").splitlines()
    assert text[0] == "Ranking" and [line.split()[0] for line in text[3:]] == ["overall", "easy", "hard", "(none)"] and len({len(x) for x in text[1:]}) == 1
    row = spark.range(1).select(reports.mean_and_spread(F.lit(0.821), F.lit(0.03)).alias("a"), reports.mean_and_spread(F.lit(0.5), F.lit(0.0)).alias("b"), reports.share(F.lit(None).cast("double")).alias("c")).first()
    assert tuple(row) == ("82.1% ± 3.0%", "50.0%", "-")
    with pytest.raises(ValueError):
        reports.as_text(results, max_rows=2)


def test_lost_tasks_are_error_rows(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("b",)], "task_id string")
    results = spark.createDataFrame([("a", 0.7)], "task_id string, reward double")
    assert {tuple(r) for r in reports.with_errors(tasks, results).collect()} == {("a", 0.7, None), ("b", None, "no result")}


def test_profile_text():
    p = ColumnProfile("tags_n", "int", 10, 8, 0.2, 3, 0.375, "int_numeric", {"siblings": ["tags"]}, ["filterable_numeric"])
    assert reports.profile_text([p]) == "tags_n: int_numeric; 20.0% null; 3 distinct; tags filterable_numeric; beside tags"


def test_answers_and_settings():
    assert reports.kept_columns([" a ", {"column": "b", "reason": " why "}, {"column": " "}, 3, {"reason": "x"}, ""]) == {"a": "", "b": "why"}
    assert reports.kept_columns("a") == {} and reports.batches([1, 2, 3], 2) == [[1, 2], [3]]
    assert reports.stage_setting("triage", {"triage": "x", "*": "y"}, "z") == "x" and reports.stage_setting("other", {"*": "y"}, "z") == "y" and reports.stage_setting("a", None, "z") == "z"


def test_declared_rules():
    check = coherent(reports.declared_rules([{"never": [{"name": "price_max", "op": "lte", "value": 500}, {"name": "ram_min", "op": "gte", "value": 32}]}, {"never": [{"name": "gpu", "op": "in", "value": ["Integrated"]}, {"name": "use", "op": "eq", "value": "gaming"}]}]))
    assert check({"price_max": 400, "ram_min": 16}) and not check({"price_max": "400", "ram_min": 64}) and check({"price_max": 400}) and check({"price_max": "cheap", "ram_min": 64})
    assert not check({"gpu": "integrated", "use": "GAMING"})
    with pytest.raises(ValueError):
        reports.declared_rules([{"never": [{"name": "x", "op": "near", "value": 1}]}])


def test_marked_attributes_and_softened_constraints():
    from lodestock.model import AttributeSpec, ConstraintSpec, Domain, Preference

    d = Domain("d", "id", [AttributeSpec("name", embedding_field=True), AttributeSpec("reviews", popularity_proxy=True), AttributeSpec("text", embedding_field=True)])
    d.constraints = [ConstraintSpec("price_max", "price", "lte", demotable=True, soft_direction="minimize"), ConstraintSpec("brand", "brand", "eq", demotable=True), ConstraintSpec("ram", "ram", "gte")]
    assert d.popularity() == "reviews" and d.embedding_columns() == ["name", "text"] and Domain("e", "id").popularity() is None
    hard, soft = d.demoted({"ram": 8, "brand": "x", "price_max": 500})
    assert hard == {"ram": 8} and soft == [Preference("price", "minimize", None, 1), Preference("brand", "match", "x", 2)]
