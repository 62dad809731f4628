"""Every registered query against its DuckDB oracle (the driver's gate).

Runs at sf0.001 by default; RANKWISE_ORACLE_SF=/root/testdata/sf0.01 for
the driver's scale.  RANKWISE_ORACLE_ALL=0 limits it to a quick subset."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402

QUICK = ["ranked_overview", "consensus_ranking", "rater_vs_consensus_label_sequence", "pairwise_agreement",
         "job_metrics", "native_scores", "parsed_score_answers", "parsed_requirements", "timer_pairs",
         "language_tags", "workloads", "chat_layout_instruction"]


def _names():
    from rankwise.plans import catalog
    if os.environ.get("RANKWISE_ORACLE_ALL", "1") == "0":
        return QUICK
    return [n for n in catalog.oracle_sql()]


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, name):
    from oracle_check import compare
    sf = os.environ.get("RANKWISE_ORACLE_SF", SF_SMALL)
    res = compare(spark, sf, {name}, verbose=False)
    assert res[name] == "ok", res[name]


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
    assert set(e.oracle_sql()) <= set(e.queries())
