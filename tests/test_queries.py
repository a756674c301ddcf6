"""Every query of the core with SQL equals it; the others run with a fixed schema."""

import pytest

from chronoweave.plans import evaluation, general, graph, models, streams
from tests.oracle import compare, connect

QUERIES = general.QUERIES | graph.QUERIES | models.QUERIES | streams.QUERIES | evaluation.QUERIES
ORACLES = general.ORACLES | graph.ORACLES | models.ORACLES | streams.ORACLES | evaluation.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, con, spark, sf):
    compare(con, spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
