"""Tables of nodes are shuffled: Spark takes their size from small files, and the driver can't hold what it would broadcast."""

import pytest

from grovespark.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["radius_edges", "alive_edge_filter", "sample_edges", "sample_skeleton"])
def test_nodes_are_not_broadcast(spark, name):
    """Planned alone, not run."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
