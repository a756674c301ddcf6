import pytest

from chronoweave.llm import queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, con, spark, sf):
    compare(con, spark, sf, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_round_trip(spark, sf):
    assert queries.p6_round_trip(spark, sf).filter("not same").count() == 0
