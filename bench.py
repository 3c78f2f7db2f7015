"""Wall time of headline queries. Prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names, to time a few
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from probity.plans.catalog import load  # noqa: E402
from probity.session import local_session, release  # noqa: E402

HEADLINE = [
    "overall_analysis", "rule_class", "softmax_probabilities", "content_features", "days_since_last_review",
    "rolling_stars", "reviewer_profile", "business_profile", "rating_deviation", "category_summary",
    "isolation_forest", "fusion_features", "threshold_decision", "per_class_scores", "ranking_metrics",
    "class_average_precision", "stage_complement", "batch_summary", "detailed_batch_stats", "daily_trend",
    "violation_counts", "label_prompts", "labelled_rows", "budgeted_routing", "cost_grid", "burst_score",
    "sliced_metrics", "threshold_sweep", "stream_totals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    catalog = load()
    spark = local_session(cores, "bench")
    # One small query starts the JVM's compilers and the Python workers before the clock runs.
    catalog.queries["overall_analysis"](spark, folder).collect()
    times = {}
    for name in only or HEADLINE:
        start = time.time()
        catalog.queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    release(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
