"""Queries that once saw part of their input see all of it."""

from pyspark.sql import functions as F

from lodestock.plans.registry import QUERIES
from lodestock.sources.tables import table


def test_every_part_is_recommended(spark, small):
    parts = table(spark, small, "part").count()
    assert parts > 125
    assert QUERIES["w_csr"](spark, small).agg(F.sum("n")).first()[0] == parts
    ranked = QUERIES["w_ndcg"](spark, small).agg(F.sum("num_recommendations"), F.max("num_recommendations")).first()
    assert ranked[0] == parts and ranked[1] > 5


def test_details_of_every_part(spark, small):
    part = table(spark, small, "part")
    out = QUERIES["x_details_unpivot"](spark, small)
    assert out.count() == part.select(F.sum(sum(F.col(c).isNotNull().cast("int") for c in ("p_name", "p_brand", "p_size")))).first()[0]
    assert out.where("p_partkey > 20").select("p_partkey").distinct().count() == part.where("p_partkey > 20").count() > 0


def test_labels_of_every_game(spark, small, tmp_path):
    games, out = table(spark, small, "games"), QUERIES["c_formatting"](spark, small)
    assert out.count() == games.count()
    assert out.where("price_label is null").count() == games.where("price is null").count() > 0
    spark.createDataFrame([(1, 1234.5, ["a"]), (2, None, ["b"]), (3, 0.0, None)], "game_id int, price double, genres array<string>").write.parquet(f"{tmp_path}/games.parquet")
    got = {tuple(r) for r in QUERIES["c_formatting"](spark, str(tmp_path)).collect()}
    assert got == {(1, "$1,234.50", "a"), (2, None, "b"), (3, "Free to Play", None)}
