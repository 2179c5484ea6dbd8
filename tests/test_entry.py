"""The registered queries: oracle agreement at the smallest scale and plan shape."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare, connect

SQL = entry.oracle_sql()



@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SMALL), duck, SQL[name]) is None


@pytest.mark.parametrize("name", ["w1_state_density", "a14_state_table", "p27_p16_accessibility", "p12_outlier_flag"])
def test_plans_have_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
