import pytest

from folio.plans import registry
from tests.oracle import connect, same

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    assert name in QUERIES
    same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()
