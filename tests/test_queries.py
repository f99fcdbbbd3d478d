"""Every registered query against its SQL on whole tables, and the shape of its plan."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from suite import fixtures
from suite.check import compare, connect

NAMES = list(fixtures.QUERIES)
WORKERS = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def cluster_shaped(df):
    """No Python workers and no cross joins anywhere."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in WORKERS + CROSS if bad in plan]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    verdict, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), sf_dir, cluster_shaped)
    assert not verdict.startswith("FAIL"), verdict


def test_every_query_has_sql():
    assert set(fixtures.ORACLE) == set(fixtures.QUERIES)
    assert set(fixtures.QUERIES) <= set(queries()) and set(fixtures.ORACLE) <= set(oracle_sql())


def test_entry_runs(spark):
    assert entry(spark).count() == 8
