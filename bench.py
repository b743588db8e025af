"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default the largest local scale), BENCH_CPUS the cores. Each
query runs once to warm up and then BENCH_RUNS times; the median counts, from building the
plan to the last row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from comarca.session import local_session  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "weighted_share_long",
    "locality_share",
    "direct_value",
    "survey_long",
    "survey_wide",
    "context_long",
    "alias_lookup",
    "text_fold",
    "label_lookup",
    "catalog_variables",
    "coverage_municipality",
    "point_in_polygon",
    "tile_coverage_state",
    "opportunity_score",
    "metric_extremes",
    "section_insights",
    "validation_checks",
    "raw_profile",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, shuffle_partitions=cores)
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
