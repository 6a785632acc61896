"""Plans of the training-data operators."""

import re

import pytest

from meterflow.llm.queries import QUERIES
from tests.conftest import SF_SMALL

NATIVE = [k for k in QUERIES if re.match(r"op[1-4]_", k)]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_products(spark, key):
    plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("key", NATIVE)
def test_native_operators_run_no_python(spark, key):
    plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_windows_scan_keeps_its_join_broadcast(spark):
    plan = QUERIES["op4_decontamination"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
