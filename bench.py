"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motorspark import catalog  # noqa: E402
from motorspark.session import local_session  # noqa: E402

HEADLINE = [
    "rule_audit", "clean_listings", "segment_curves", "brand_summary", "depreciation_by_brand", "ols_importance",
    "spikes", "exposure_ranks", "severity_levels", "recall_features", "coverage_recalls", "tfidf_weights", "nmf_topics",
    "spec_decisions", "sessions", "quality_report", "rolling_features", "trip_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores, 8)
    seconds = {}
    for name in names:
        timed = []
        for attempt in range(runs + 1):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                timed.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timed), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
