"""Rules on column profiles, fixed word lists, plug-ins and the shared folder."""

import sys
from types import SimpleNamespace

import pytest

from lodestock import fixed
from lodestock.functions import plugins
from lodestock.operators import calibrate, configgen, desc, profile
from lodestock.sources import shared


def column(name, kind="int_numeric", n_unique=50, null_rate=0.0, n=2000, **details):
    p = profile.ColumnProfile(name, "bigint", n, int(n * (1 - null_rate)), null_rate, n_unique, n_unique / n, kind, details)
    p.tags = profile.tags_of(p)
    return p


def reasons(*columns):
    return profile.triage(list(columns))


def test_audit_timestamps_are_told_by_name_and_value():
    epoch = {"min": 1.6e9, "max": 1.7e9, "std": 3.0}
    got = reasons(*[column(n, **epoch) for n in ("last_modified", "foo_created", "last_updated_t", "build_ts", "load_t", "entry_date")], column("foo_updated", min=5.0))
    assert got["last_modified"] == got["foo_created"] == got["last_updated_t"] == "audit timestamp"
    assert got["build_ts"] is None and got["load_t"] is None and got["foo_updated"] is None
    assert got["entry_date"] == "noise: noise_timestamp"


def test_schema_metadata():
    got = reasons(*[column(n) for n in ("schema", "data_schema_version", "API_version", "rev", "version_name")])
    assert got == {"schema": None, "data_schema_version": "schema metadata", "API_version": "schema metadata", "rev": "schema metadata", "version_name": None}


def test_other_rules_in_their_order():
    got = reasons(
        column("a", "all_null", 0, 1.0), column("b", n_unique=1), column("c", null_rate=0.8), column("d", "string_long_text", null_rate=0.8), column("e", "bool", 2, true_rate=0.99),
        column("tags_n"), column("tags", "list_of_values", n_elements=5000, n_labels=40), column("photo_count"), column("few", "list_of_values", n_elements=20, n_labels=3),
    )
    assert got == {"a": "all null", "b": "constant column", "c": "sparse", "d": None, "e": "near-constant boolean", "tags_n": "redundant count of list", "tags": None, "photo_count": "noise: noise_media_reference", "few": "noise: noise_near_empty_list"}


def test_only_usable_lists_count_as_filters():
    assert "filterable_after_flattening_or_membership" in column("l", "list_of_values", n_elements=500, n_labels=9).tags
    one = column("l", "list_of_values", n_elements=500, n_labels=1)
    assert "single_repeated_tag_only" in one.tags and "filterable_after_flattening_or_membership" not in one.tags
    assert profile.assess([one])["n_filters"] == 0
    assert profile.id_like("item_id", 100, 100) and profile.id_like("SKU", 99, 100) and not profile.id_like("width", 100, 100) and not profile.id_like("sku", 90, 100)


def test_word_lists_differ_by_use(spark):
    rates = spark.createDataFrame([("c", v, 9, 0.5) for v in ("Other", "not-applicable", " en:undefined", "?", "red")], "name string, value string, hits long, rate double")
    assert {r.value for r in calibrate.pruned(rates).collect()} == {"Other", "red"}
    values = spark.createDataFrame([(v,) for v in ("Other", "not available", "nil", "?", "not-applicable", "red")], "value string")
    assert {r.value for r in configgen.sanitised(values).collect()} == {"Other", "not-applicable", "red"}
    texts = spark.createDataFrame([(v,) for v in ("Other", "Unspecified", "n.a.", "--", "?", "red", None)], "t string")
    assert {r.t for r in desc.usable(texts, "t").collect()} == {"?", "red"}
    assert fixed.noise_tag("Editors_names") == "noise_audit_trail" and fixed.noise_tag("created_by") == "noise_timestamp" and fixed.noise_tag("recreated") is None


def test_element_profile(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["a", None],)], "l array<string>")
    r = profile.element_profile(df, "l").first()
    assert (r.element_type, r.n_singletons, r.mean_elements, r.top1_share) == ("string", 1, 1.3333, 0.75)
    j = spark.createDataFrame([('[1, "a", null, true, 2.5, {"k": 1}, [1]]',), ("no list",), (None,)], "j string")
    assert {r.element_type: r.n for r in profile.element_types(j, "j").collect()} == {"bigint": 1, "string": 1, "null": 1, "boolean": 1, "decimal": 1, "object": 1, "array": 1}


def test_plugins(spark):
    assert plugins.register(spark) == ["geometric_mean", "word_pairs"]
    df = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("b", -1.0), ("b", None)], "k string, v double")
    assert {r.k: r.g for r in spark.sql("select k, geometric_mean(v) g from {d} group by k", d=df).collect()} == {"a": pytest.approx(4.0), "b": None}
    assert [tuple(r) for r in spark.sql("select * from word_pairs('x y z')").collect()] == [(1, "x y"), (2, "y z")]
    assert spark.sql("select * from word_pairs(cast(null as string))").count() == 0


def test_shared_folder_of_a_cluster_must_be_named(spark, monkeypatch):
    for master, refused in (("spark://h:7077", True), ("local-cluster[3,2,1024]", True), ("yarn", True), ("local[4]", False), ("local", False)):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master=master))
        if refused:
            with pytest.raises(ValueError):
                shared.shared_root(session)
        else:
            assert shared.shared_root(session).startswith("file://")


def test_forget_deletes_what_was_kept(spark):
    kept = shared.keep(spark.range(5).toDF("x"), "gone")
    assert kept.count() == 5 and shared.forget(spark) >= 1 and shared.forget(spark) == 0
    root, name = kept.inputFiles()[0].rsplit("/", 2)[:2]
    assert name not in shared.names_in(spark, root)


def test_small_files(spark):
    path = shared.new_path(spark, "note")
    shared.write_text(spark, f"{path}/a.json", "täxt")
    assert shared.read_text(spark, f"{path}/a.json") == "täxt" and shared.names_in(spark, path) == ["a.json"] and shared.names_in(spark, path + "x") == []


def test_entry_without_a_library_of_the_other_queries(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "lodestock.llm.queries", None)
    assert len(entry.queries()) > 100 and not any(n.startswith("p1_") for n in entry.queries())


def test_one_order_without_one_task(spark):
    import random

    from lodestock.operators import scoring

    rng = random.Random(6)
    rows = [(i, float(rng.randint(0, 40))) for i in range(400)]
    got = {r.pid: (r.position, r.best) for r in scoring.ranked(spark.createDataFrame(rows, "pid int, utility double"), "pid").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {pid: (i, u == order[0][1]) for i, (pid, u) in enumerate(order, 1)}


def test_pool_index_beyond_the_driver(spark):
    import random

    from lodestock.model import ConstraintSpec

    rng = random.Random(7)
    df = spark.createDataFrame([(float(rng.randint(1, 90)), rng.choice("abc")) for _ in range(300)], "price double, brand string")
    registry = [ConstraintSpec("p", "price", "lte", sampling_values=list(range(1, 91))), ConstraintSpec("b", "brand", "eq", sampling_values=["a", "b"])]
    held, spread = calibrate.PoolIndex(df, registry), calibrate.PoolIndex(df, registry, max_signatures=10)
    assert held.table is None and spread.table is not None and not spread.rows
    for c in ({}, {"p": 40}, {"p": 77, "b": "a"}, {"b": "b"}):
        assert held.size(c) == spread.size(c)
