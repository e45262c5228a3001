"""The queries that are timed run the whole method."""

from lodestock.llm import queries
from lodestock.sources.shared import keep


def _kept(monkeypatch, spark, small, name):
    seen = {}

    def record(df, label="stage", *by):
        seen[label] = keep(df, label, *by)
        return seen[label]

    monkeypatch.setattr(queries, "keep", record)
    return queries.QUERIES[name](spark, small), seen


def test_p7_found_assigns(monkeypatch, spark, small):
    out, seen = _kept(monkeypatch, spark, small, "p7_found")
    assert seen["assigned"].count() == queries.QUERIES["p7_order"](spark, small).count() > 0
    report = queries.QUERIES["p7_report"](spark, small).where("cannot_fill").select("mix_id", "source")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in report.collect()}


def test_p1_found_draws(monkeypatch, spark, small):
    _, seen = _kept(monkeypatch, spark, small, "p1_found")
    assert seen["sample"].count() == queries.QUERIES["p1_sample"](spark, small).count() > 0
