"""Time the headline queries; one JSON line on stdout.

Every query is built and run to its last row (a no-op sink, so nothing is collected).
All queries run twice to warm up the engine; the median of the next three runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from firelake.checks.registry import registered
from firelake.session import local_session

HEADLINE = [
    "latest_fires",
    "latest_fires_region",
    "latest_fires_confidence",
    "latest_fires_region_confidence",
    "latest_features",
    "feature_matrix",
    "join_weather_first",
    "dedup_insert",
    "ingest_counts",
    "distinct_cells_weather",
    "join_region_boxes",
    "kpi_summary",
    "cluster_counts",
    "heat_points",
    "request_metrics",
    "sort_events",
    "regressions",
    "roc_auc",
    "confusion_metrics",
    "parse_forecast_json",
]
WARM_UPS = 2
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("firelake-bench", cores, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = registered()

    def once(name: str) -> float:
        start = time.perf_counter()
        found[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE * WARM_UPS:
        once(name)
    seconds = {name: round(statistics.median(once(name) for _ in range(RUNS)), 3) for name in HEADLINE}
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, warm median",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
