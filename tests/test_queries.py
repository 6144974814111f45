import os

import pytest

from specsift.plans import registry
from tests.oracle_check import DATA, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, registry.queries()[name], SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert set(df.columns) >= {"doc_id", "conflicts", "issues"} and df.count() > 0
