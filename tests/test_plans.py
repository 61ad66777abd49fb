"""What the plans of the queries outside ``llm`` must not hold."""

import pytest

import __spark_entry__ as contract
from tests.plans import executed_plan

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for plan in contract._PLANS for name, query in plan.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = executed_plan(QUERIES[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas", "MapInArrow"):
        assert unwanted not in plan
    # An unkeyed window runs in one task; only the peak over all runs has one, over whole blocks.
    if name != "open_requests_global":
        assert "Exchange SinglePartition" not in plan or name in ("cross_join_views", "peek_rows")


def test_global_peak_sends_blocks_not_rows_to_one_task(spark):
    plan = executed_plan(contract.queries()["open_requests_global"](spark, SF_DIR))
    single = plan.index("Exchange SinglePartition")
    assert "hashpartitioning(__block" in plan[single:]
    assert "hashpartitioning(at_ms" in plan[single:]
