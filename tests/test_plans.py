"""Plan inspection: no registered query plans a cartesian product or a
nested-loop join (bounded pair sets are formed inside one row instead)."""

import contextlib
import io

import pytest

import __spark_entry__ as se
from tests.conftest import SF001

SLOW = {"cluster_texts", "cluster_texts_stats", "cluster_scores", "assign_cluster", "truncated_svd",
        "cluster_texts_agglomerative", "cluster_texts_before", "tsne_layout"}


@pytest.mark.parametrize("name", sorted(set(se.queries()) - SLOW))
def test_no_cartesian_or_nested_loop_join(spark, name):
    df = se.queries()[name](spark, SF001)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    plan = buf.getvalue()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
