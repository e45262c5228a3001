import pytest

from lodestock.llm import queries
from tests.test_oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees(spark, small, name):
    compare(spark, small, queries.QUERIES, queries.ORACLES, name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0
