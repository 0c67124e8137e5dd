"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Each query runs once to warm up, then three times; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gridsmith.queries import QUERIES
from gridsmith.testing import local_session

HEADLINES = [
    "flagship_fill_feature_summary",
    "summary_analyze_numeric",
    "correlation_pearson",
    "correlation_spearman",
    "anova_scan",
    "cleaning_pipeline",
    "join_chain",
    "join_full_outer",
    "missing_forward_fill",
    "relationships_discover",
    "features_group_aggregates",
    "duplicates_report",
    "chart_box_by_group",
    "ml_classification_logistic",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINES
    spark = local_session()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries (median of 3 warm runs each)",
                "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale,
            }
        )
    )


if __name__ == "__main__":
    main()
