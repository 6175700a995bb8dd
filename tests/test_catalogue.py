"""Every query of the engine against its SQL."""

import pytest
from compare import connect, difference

from strata import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""
