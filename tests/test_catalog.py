import pytest
from compare import connect, same

from tieout.catalog import QUERIES
from tieout.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLES[name])
