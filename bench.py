"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is fully executed (``write.format("noop")``) - no collect.
``BENCH_QUERIES=all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ranked_overview",                      # scoring slice (F1 on lineitem)
    "job_metrics_label_sequence",           # flagship evaluation report
    "pairwise_agreement",                   # all-pairs agreement matrix (exact tau)
    "consensus_ranking",
    "native_scores",                        # n-gram scorer, documents x benchmark
    "scored_overview",                      # end-to-end scoring front
    "answered_scores",                      # the answer step: requests, answer texts, parsing, join back
    "parsed_score_answers",
    "parsed_requirements",
    "language_tags",
    "redacted_documents",
    "links_removed",
    "timer_pairs",
    "chat_layout_instruction",
    "pseudonyms",
]


def main() -> None:
    from rankwise.plans import catalog
    from rankwise.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]")
    qs = catalog.queries()
    names = list(qs) if os.environ.get("BENCH_QUERIES") == "all" else \
        [n for n in (os.environ.get("BENCH_QUERIES") or ",".join(HEADLINE)).split(",") if n in qs]
    # warm-up (untimed): JVM code paths, parquet footers, checkpoint folder
    for warm in ("clamped_scores", "timer_rejects", "normalized_documents"):  # none fills a memo
        qs[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
