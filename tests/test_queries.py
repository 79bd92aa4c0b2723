"""Every registered query against its SQL, and what its plan may hold."""

import pytest
from check_oracle import compare, duck

import __spark_entry__
from lineforge.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_its_sql():
    assert set(oracles.ORACLES) == set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0]["lines"] >= rows[-1]["lines"]


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, con, name):
    same, message = compare(spark, con, FOLDER, name)
    assert same, message


PYTHON_QUERIES = {"lint_regex_compile", "lint_summary"}
STREAMS = {n for n in catalog.QUERIES if n.startswith("stream_")}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_plan(spark, name):
    """No cross or nested-loop join, no row-at-a-time Python, Python at all only where it must be."""
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON_QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    from lineforge.operators import alerts, metrics
    from lineforge.plans.views import Views
    from lineforge.session import materialize

    stored = materialize(Views(spark, FOLDER).metric_samples(), "samples")
    plan = metrics.metric_select(stored, "up").select("ts", "value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(metric,up)" in plan and "ReadSchema: struct<ts:timestamp,metric:string,value:double>" in plan
    rules = alerts.alert_ruleset(stored)._jdf.queryExecution().executedPlan().toString()
    assert "In(metric" in rules
