"""Every registered query with SQL agrees with it on the smallest data set."""

from pathlib import Path

import pytest
from compare import connection, differences

import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no benchmark tables here")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    made = catalog.queries()[name](spark, SF).toArrow()
    assert differences(made, con.execute(catalog.oracle_sql()[name]).to_arrow_table()) == []
