"""Plan checks: no Python evaluation in the default plans, pushdown and pruning."""

import pytest

from rankwise.plans import catalog

from conftest import SF_SMALL

JVM_ONLY = ["ranked_overview", "native_scores", "parsed_score_answers", "consensus_ranking", "pairwise_agreement",
            "timer_pairs", "language_tags", "links_removed", "chat_layout_instruction", "workloads"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_plan(spark, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_scan_prunes_columns(spark):
    # (ranked_overview ranks a checkpointed input; its scan happens in the checkpoint)
    df = catalog.queries()["weighted_totals"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "lineitem" in line]
    assert scans and all("l_extendedprice" not in s and "l_comment" not in s for s in scans)


def test_no_cross_join_or_python_anywhere(spark):
    """Every registered batch query: no cartesian product, no nested-loop
    join, no Python evaluation node in the executed plan."""
    streaming = {"stream_timer_pairs", "stream_task_time_summary", "stream_incremental_scores"}
    bad = {}
    for name, fn in catalog.queries().items():
        if name in streaming:
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        flags = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval") if k in plan]
        if flags:
            bad[name] = flags
    assert bad == {}
