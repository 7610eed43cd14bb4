"""Every registered query against its SQL at the smallest scale."""

import pytest

from oracle import connect, differences
from stayscope.suite.all_queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLE:
        assert differences(spark, duck, name, QUERIES[name], ORACLE[name], FOLDER) == ""
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_plans_have_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("a1_", "a2_", "a3_", "a4_", "a7_", "a8_", "a12_", "a14_", "a15_", "a18", "a21", "a36"))])
def test_distinct_counts_do_not_multiply_rows(spark, name):
    assert "Expand" not in QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
