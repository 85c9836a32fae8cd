"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default headline; "all" runs every query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakewarden.session import local_session  # noqa: E402
from workload import load_all  # noqa: E402

HEADLINE = [
    "pii_redact_documents", "pii_redact_pages", "pii_profile_documents", "pii_numeric_columns",
    "entity_matches", "join_candidates", "join_mining", "policy_decisions", "policy_access_review", "policy_mask_gate",
    "governed_join", "governed_agg", "governed_window", "audit_actions", "audit_outcomes", "quota_free_plan",
    "relationship_upsert", "question_ranking", "metric_requests", "page_text", "csv_fields_sampled", "statement_gate",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    queries, _ = load_all()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), **{"spark.ui.showConsoleProgress": "false"})
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        taken = []
        for attempt in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:  # the first run warms up
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
