"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds (median of three warm runs)."""

from __future__ import annotations

import json
import os
import statistics
import time

from weft.plans.catalogue import QUERIES
from weft.session import local

HEADLINES = ["threshold_sweep_ods", "sweep_report", "class_metrics", "path_geometry", "path_curvature", "path_orientation", "edge_topology", "line_graph", "neighbour_stats", "junction_policy", "khop_context", "component_structure", "hysteresis", "dilate", "close", "nearest_seed", "tile_blend", "label_vote", "candidate_rank", "longest_prefix", "group_folds", "user_sessions"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"))

    def timed(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in HEADLINES:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(3)), 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
