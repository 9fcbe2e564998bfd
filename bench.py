"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tallyflow.plans import QUERIES
from tallyflow.session import local_session

HEADLINE = [
    "cube_filter_agg",
    "cube_map_m2m",
    "cube_map_two_dims",
    "cube_filter_mapped",
    "cube_densify",
    "pivot_totals",
    "labels",
    "code_list_prefix",
    "rollup_zero",
    "rollup_per_period",
    "weights_infer",
    "propagate_fixpoint",
    "components",
    "observer_priority",
    "local_indicator",
    "global_indicator",
    "characterize",
    "benchmark_ranges",
    "matrix",
    "sankey_links",
    "wildcard_relations",
    "solve",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tallyflow-bench")
    QUERIES["cube_default_average"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM start-up
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
