"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import connect, difference, spark_result, sql_result
from checks.oracle import SQL
from checks.queries import registered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registered()) == set(SQL)


@pytest.mark.parametrize("name", list(registered()))
def test_query_agrees_with_sql(spark, con, name):
    found = spark_result(registered()[name](spark, SF_DIR))
    assert found[1]
    assert difference(found, sql_result(con, SQL[name])) is None
