"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from touchcredit.registry.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_registry_is_whole():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 3


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    assert compare.spark_rows(df) == compare.duck_rows(con, oracle_sql()[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert bad not in plan
