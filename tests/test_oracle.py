"""Every query against its SQL on the driver tables; the others must give rows."""

import pytest

import __spark_entry__ as entry_point
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.01"
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for avoided in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert avoided not in plan
    if name in SQL:
        assert differences(df, tables, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
