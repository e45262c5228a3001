"""Profiles, pool index, resolution, search, sources, stages and streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestock.functions import text as X
from lodestock.model import Bracket, ConstraintSpec, Domain
from lodestock.operators import calibrate, configgen, desc, profile, resolve, search, tasks
from lodestock.operators.predicates import constraint_filter
from lodestock.operators.tools import Tool, ToolBox
from lodestock.sources import readers
from lodestock.streaming import results

REG = [
    ConstraintSpec("price_max", "price", "lte", value_type="float", sampling_values=[5, 10, 20]),
    ConstraintSpec("brand", "brand", "eq", sampling_values=["a", "b"]),
    ConstraintSpec("tags_includes", "tags", "contains_any", value_type="list[str]", sampling_values=["x", "y"]),
]


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(1, 30)) if i % 9 else None, rng.choice(["a", "b", "A", None]), rng.sample(["x", "y", "z"], rng.randint(0, 3)), f"item {i} red fox{i % 3}") for i in range(200)]
    return spark.createDataFrame(rows, "id int, price double, brand string, tags array<string>, text string")


def test_pool_index_counts_as_filters_do(items):
    index = calibrate.PoolIndex(items, REG)
    for c in ({"price_max": 10}, {"price_max": 20, "brand": "a"}, {"price_max": 5, "brand": "b", "tags_includes": "x"}, {}):
        assert index.size(c) == constraint_filter(items, c, REG).count()
    assert calibrate.PoolIndex(items, REG, max_signatures=1).size({"price_max": 10}) == index.size({"price_max": 10})  # more signatures than the driver takes


def test_sampling_fits_the_bracket(items):
    index = calibrate.PoolIndex(items, REG)
    found = tasks.sample_constraints(index, REG, Bracket("t", 5, 60, 2), random.Random(4))
    assert found and 5 <= found[1] <= 60 and len(found[0]) >= 2 and index.size(found[0]) == found[1]
    harder = tasks.tightened(index, {"price_max": "20"}, 3)
    assert index.size(harder) <= index.size({"price_max": "20"})
    p = calibrate.calibrated(index, {"price_max": 0.9, "brand": 0.9, "tags_includes": 0.9}, {"brand": 0.1}, mean=1.5)
    assert all(0.05 <= x <= 0.9 for x in p.values())


def test_kinds_tags_and_triage(spark):
    df = spark.createDataFrame(
        [(i, None, i % 2, float(i), f"w{i % 3}", "long " * 40, [i], f"2020-01-{i % 28 + 1:02d}", "same", i * 1e9 + 2e9, 1) for i in range(40)],
        "item_id int, gone string, flag int, whole double, word string, prose string, tags array<int>, day string, photo_url string, last_updated_t double, tags_n int",
    ).withColumn("day", F.to_date("day"))
    ps = {p.name: p for p in profile.profile_columns(df, batch=4)}
    kinds = {n: p.kind for n, p in ps.items()}
    assert kinds == {
        "item_id": "int_numeric", "gone": "all_null", "flag": "bool", "whole": "int_numeric", "word": "string_categorical", "prose": "string_long_text",
        "tags": "list_of_values", "day": "datetime", "photo_url": "string_categorical", "last_updated_t": "int_numeric", "tags_n": "bool",
    }
    assert "candidate_identifier_column" in ps["item_id"].tags and ps["tags"].details["siblings"] == ["tags_n"] and ps["word"].n_unique == 3
    why = profile.triage(list(ps.values()))
    assert why["gone"] == "all null" and why["prose"] == "constant column" and why["last_updated_t"] == "audit timestamp" and why["word"] is None
    assert 1 <= profile.assess(list(ps.values()))["score"] <= 10 and profile.assess([])["verdict"] == "poor"
    assert all(p.kind == "all_null" for p in profile.profile_columns(df.limit(0)))


def test_resolution():
    words = ["Quay & Co", "Brightmoor", "en:Zelkova"]
    assert resolve.fuzzy_value("brightmor", words) == "Brightmoor" and resolve.fuzzy_value("zelkova", words) == "en:Zelkova" and resolve.fuzzy_value("qqq", words) is None
    assert resolve.fuzzy_field("Price USD", ["price_usd", "name"]) == "price_usd" and resolve.fuzzy_field("cost", ["price"], {"cost": "price"}) == "price"
    got, notes = resolve.resolve_constraints({"brand": ["brightmor"], "x": 3}, {"brand": words})
    assert got == {"brand": ["Brightmoor"], "x": 3} and len(notes) == 1
    assert resolve.coerce("3", "int") == 3 and resolve.coerce("a, b", "list[str]") == ["a", "b"] and resolve.coerce("no", "bool") is False


def test_search_weighs_repeats_and_partial_hits(items):
    n = items.count()
    out = {r.id: r.score for r in search.keyword_by_token(items, "fox1 fox1 re", ["text"]).collect()}
    df1 = items.where("text like '%fox1'").count()
    idf1, idf_re = math.log((n + 1) / (df1 + 1)) + 1, math.log(n + 1) + 1
    assert math.isclose(out[1], 2 * idf1 + 0.5 * idf_re) and math.isclose(out[0], 0.5 * idf_re)
    assert search.keyword_by_token(items, "", ["text"]).count() == 0 and search.keyword_by_token(items, "red", ["nope"]).count() == 0


def test_tools(items):
    box = ToolBox(Domain("d", "id", constraints=REG), items, [Tool("cheapest", "", lambda: items.orderBy("price", "id").where("price is not null").limit(1))])
    assert box("filter_items", price_max="5", limit=3, sort_by="price").count() == 3
    assert box("cheapest").count() == 1 and box("get_item", item_id="8").where("label = 'id'").first().value == "8" and box.filters().count() == 3
    assert box("list_filter_values", name="tags_includes").count() == 3
    with pytest.raises(KeyError):
        box("nope")


def test_sources(spark, tmp_path, items):
    flat = items.drop("tags")
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\"y, z\"\n")
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\n")
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\nbroken\n')
    (tmp_path / "a.json").write_text('[\n {"id": 1},\n {"id": 2}\n]')
    flat.write.parquet(str(tmp_path / "catalog.parquet"))
    assert readers.read_any(spark, str(tmp_path / "a.csv")).count() == 2 and readers.read_any(spark, str(tmp_path / "a.tsv")).columns == ["id", "name"]
    assert readers.read_any(spark, str(tmp_path / "a.jsonl")).where("id is not null").count() == 2 and readers.read_any(spark, str(tmp_path / "a.json")).count() == 2
    Domain("d", "id", constraints=REG, brackets=[Bracket("x", 1, 2)]).save(tmp_path / "config.json")
    (tmp_path / "extras").mkdir()
    (tmp_path / "extras" / "tasks.json").write_text(json.dumps([{"task_id": "t"}]))
    domain, catalog, todo = readers.load_domain(spark, str(tmp_path))
    assert domain.constraints == REG and catalog.count() == 200 and todo.count() == 1 and domain.check(catalog) == ["tags"]
    (tmp_path / "desc.json").write_text(json.dumps({"products": {"1": {"a": "x", "b": "y"}, "2": {}}}))
    assert {tuple(r) for r in readers.described_values(spark, str(tmp_path / "desc.json")).collect()} == {("1", "a", "x"), ("1", "b", "y")}
    stages = readers.Stages(spark, str(tmp_path / "stages"))
    assert stages.get("one", lambda: flat).count() == 200 and stages.get("one", lambda: 1 / 0).count() == 200
    readers.write_results(flat.limit(2), str(tmp_path / "out"))
    readers.write_results(flat.limit(1), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_functions(spark):
    row = spark.range(1).select(
        X.tokens(F.lit("A red-fox, x 42!")).alias("t"), X.parse_list(F.lit("['a', \"b\",]")).alias("l"), X.short_list(F.array(*[F.lit(c) for c in "abcde"])).alias("s"), X.abbreviated(F.lit(3_449_999)).alias("m"),
        X.label(F.lit(3.0)).alias("n"), X.unfence(F.lit("x ```json\n{}\n```")).alias("j"), X.human(F.lit(2.5)).alias("h"), F.aggregate(X.unit(F.array(F.lit(3.0), F.lit(4.0))), F.lit(0.0), lambda s, x: s + x).alias("u"),
    ).first()
    assert row.t == ["red", "fox", "42"] and row.l == ["a", "b"] and row.s == "a, b, c (+2 more)" and row.m == "3.4M" and row.n == "3" and row.j == "{}" and row.h == 2.0 and abs(row.u - 1.4) < 1e-12


def test_derivation():
    assert [c.operator for c in configgen.derive_constraints("price", "float_numeric", 50, "minimize")] == ["lte"]
    assert configgen.derive_constraints("g", "list_of_values", 9, polarity="exclude")[0].operator == "not_contains_any"
    assert configgen.derive_constraints("b", "string_categorical", 11)[0].operator == "in_set" and configgen.derive_constraints("t", "string_long_text", 11) == []
    assert [b.hi for b in calibrate.brackets_of(100_000)] == [1000, 300, 100, 3, 0]
    rule = configgen.coherent([configgen.bounds_agree("lo", "hi")])
    assert rule({"lo": 1, "hi": 2}) and not rule({"lo": 3, "hi": 2})


def test_descriptions(spark):
    long = spark.createDataFrame([("1", "a", "x", 1), ("1", "b", "y", 0), ("2", "a", "x", 1), ("2", "c", "1", 1)], "pid string, attr string, value string, pos int")
    m = spark.createDataFrame([("a", "k"), ("b", "k")], "raw string, canonical string")
    assert {tuple(r) for r in desc.canonical_first(long, m, "pos").collect()} == {("1", "k", "y"), ("2", "k", "x")}
    e = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "pid string, pos int")
    r = spark.createDataFrame([("2", 1, "b"), (None, 2, "p"), (None, 3, "q")], "pid string, pos int, payload string")
    assert {tuple(x) for x in desc.positional(e, r).collect()} == {("2", "b"), ("1", "p"), ("3", "q")}


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(f"t{i}", "easy" if i % 2 else "hard", i / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "task_id string, difficulty string, reward double")
    readers.write_results(df, str(tmp_path / "in"))
    live = results.run_available(results.live_difficulty(results.result_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "live"))
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in results.live_difficulty(df).collect()}


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    df = spark.createDataFrame([("t1", "easy", 0.5)], "task_id string, difficulty string, reward double")
    for n in (1, 2):
        readers.write_results(df, str(tmp_path / "in"), append=True)
        live = results.run_available(results.live_difficulty(results.result_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "live"))
        assert [tuple(r) for r in live.collect()] == [("easy", n, 0.5)]
