"""The native operators run without Python in their plans."""

import pytest

from tallyfield.llm.plans import QUERIES
from tests.plans import executed_plan


@pytest.mark.parametrize("name", ["op5_pseudonyms", "op8_decontamination", "op9_shards"])
def test_no_python_in_the_plan(spark, name):
    plan = executed_plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for unwanted in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"):
        assert unwanted not in plan
