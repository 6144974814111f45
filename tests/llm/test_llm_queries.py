import os

import pytest

from specsift.llm import registry
from tests.oracle_check import DATA, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, registry.queries()[name], SQL[name], connect())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs_and_found_rows_are_distinct(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    if name.endswith("_found"):
        assert rows and len(rows) == len(set(map(tuple, rows)))
