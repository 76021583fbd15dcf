"""Every registered query against its SQL, and properties of the plans."""

import re

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from meterwise.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, database, name):
    rows, wrong = compare(spark, database, name, SF_DIR)
    assert not wrong
    assert rows > 0


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() == 137
    assert frame.schema == contract.entry(spark).schema


@pytest.mark.parametrize("name", [n for n in registry.queries() if not n.startswith("stream")])
def test_no_pairwise_joins(spark, name):
    plan = registry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_baseline_shuffles_all_rows_once(spark):
    """The branch with the edge rows reuses the shuffle of the main branch."""
    frame = registry.queries()["detect_cost_spike"](spark, SF_DIR)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
