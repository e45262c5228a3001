import pytest
from pyspark.sql import functions as F

from lodestock.llm.mixing import assign, curriculum, length_curriculum, mix_sources, report, token_counts

MIX = "mix_id string, source string, target_weight double, max_repeats long, budget_tokens long"


@pytest.fixture(scope="module")
def made(spark):
    counts = spark.createDataFrame([(i, "big" if i % 4 else "tiny", 10 + i % 3) for i in range(400)] + [(900, "big", 0)], "doc_id long, source_key string, n_tokens long")
    mix = spark.createDataFrame([("m", " Big ", 0.5, 3, 2000), ("m", "TINY", 0.4, 2, 8000), ("m", "gone", 0.1, 5, 8000)], MIX).withColumn("budget_tokens", F.lit(8000).cast("long"))
    return counts, mix


def test_demand_and_repeats(made):
    counts, mix = made
    sources = mix_sources(counts, mix)
    out = {r.source.strip().lower(): r for r in report(sources, assign(counts, sources)).collect()}
    tiny = sum(r.n_tokens for r in counts.where("source_key = 'tiny'").collect())
    assert out["tiny"].cannot_fill == (2 * tiny < 0.4 * 8000) and out["tiny"].tokens == 2 * tiny and out["tiny"].most_copies == 2
    assert not out["big"].cannot_fill and 4000 <= out["big"].tokens < 4000 + 12 and out["big"].most_copies <= 3
    assert out["gone"].cannot_fill and out["gone"].tokens == 0 and out["gone"].shortfall_tokens == 800
    assert abs(sum(r.actual_share for r in out.values()) - 1) < 1e-9


def test_positions_follow_the_schedule(made):
    counts, mix = made
    early = mix_sources(counts, mix, {"m": {"big": [(0, 1), (0.5, 0), (1, 0)]}})
    rows = assign(counts, early).collect()
    big = [r.position for r in rows if r.source.strip().lower() == "big"]
    assert max(big) <= 0.5 + 1e-9 and [r.position for r in rows] == sorted(r.position for r in rows)
    # Demand is a parabola: half of the tokens are used at 0.5 * (1 - sqrt(1/2)).
    assert abs(sorted(big)[len(big) // 2] - 0.5 * (1 - 0.5**0.5)) < 0.02
    even = [r.position for r in assign(counts, mix_sources(counts, mix)).collect() if r.source == "TINY"]
    assert max(even) > 0.95 and abs(sorted(even)[len(even) // 2] - 0.5) < 0.05


def test_curriculum_integrates_to_the_weights():
    (at, done, rate, slope), *_ = curriculum({"a": 0.3})["a"]
    assert (at, done, rate, slope) == (0.0, 0.0, 0.3, 0.0)
    pieces = curriculum({"a": 0.3}, {"a": [(0.2, 0), (0.8, 4)]})["a"]
    last = pieces[-1]
    assert abs(last[1] + (1 - last[0]) * last[2] + last[3] * (1 - last[0]) ** 2 / 2 - 0.3) < 1e-12


def test_sources_are_compared_loosely(spark):
    docs = spark.createDataFrame([(1, "one two", " A "), (2, None, "a"), (3, "x", "b"), (4, "y", None), (5, "", "A")], "doc_id long, text string, source string")
    mix = spark.createDataFrame([("m", "a", 1.0, 1, 10)], MIX)
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, mix).collect()} == {1: 2, 2: 0, 5: 0}
    empty = mix_sources(token_counts(docs.limit(0), mix), mix)
    assert empty.collect()[0].source_tokens == 0 and assign(token_counts(docs.limit(0), mix), empty).count() == 0
    assert mix_sources(token_counts(docs, mix), mix.limit(0)).count() == 0


def test_length_curriculum_brings_long_documents_late(spark):
    rows = [(i, ("short", "mid", "long")[i % 3], (5, 20, 100)[i % 3]) for i in range(900)]
    counts = spark.createDataFrame(rows, "doc_id long, source_key string, n_tokens long")
    mix = spark.createDataFrame([("m", s, w, 9, 10_000) for s, w in (("short", 0.2), ("mid", 0.3), ("long", 0.5))], MIX)
    sources = mix_sources(counts, mix, length_curriculum)
    knots = {r.source: r.knots[0] for r in sources.collect()}
    # Weights sum to 1 at the start and change by 0 in all, so they do all along.
    assert abs(sum(k.rate for k in knots.values()) - 1) < 1e-9 and abs(sum(k.slope for k in knots.values())) < 1e-9
    placed = assign(counts, sources).collect()
    half = {s: sum(r.n_tokens for r in placed if r.source == s and r.position < 0.5) / sum(r.n_tokens for r in placed if r.source == s) for s in knots}
    assert half["short"] > 0.55 > 0.48 > half["long"]
    for s, w in (("short", 0.2), ("mid", 0.3), ("long", 0.5)):
        assert 0 <= sum(r.n_tokens for r in placed if r.source == s) - w * 10_000 < 100


def test_cannot_fill_is_what_was_placed(spark):
    counts = spark.createDataFrame([(i, "s", 10) for i in range(10)], "doc_id long, source_key string, n_tokens long")
    for repeats, budget, want in ((1, 100, False), (1, 101, True), (3, 300, False), (3, 301, True), (0, 5, True)):
        mix = spark.createDataFrame([("m", "s", 1.0, repeats, budget)], MIX)
        sources = mix_sources(counts, mix, length_curriculum)
        r = report(sources, assign(counts, sources)).collect()[0]
        assert r.cannot_fill == want == (repeats * 100 < budget) and r.tokens == min(repeats * 100, budget + -budget % 10)
