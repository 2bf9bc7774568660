"""Plans of the training-data queries: no cross joins; the native ones hold no Python."""

import pytest

from marketlens.llm.queries import QUERIES

NATIVE = ("op7_", "op8_", "op10_")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_native_stays_native(spark, sf_dir, plan_of, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.startswith(NATIVE):
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
