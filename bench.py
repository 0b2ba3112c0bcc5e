"""Headline queries on ``$BENCH_SF_DIR``, one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from tallyloom.plans import load
from tallyloom.plans.catalog import QUERIES
from tallyloom.session import local_session

HEADLINE = [
    "e07_type_stats", "e08_score_hist", "e24_alignment", "e15_label_counts", "e18_win_rates",
    "f01_keep_first", "f02_merge_stripped", "f06_harvest", "f07_quota_select", "f08_stratified_snapshot",
    "f13_exact_split", "d02_exclude_known", "d03_artifact_attempts", "g06_overlap", "a13_manifest",
    "l02_type_census", "l05_edge_summary", "l06_clean_diagram", "l12_coverage", "h07_score_replies",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "tallyloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    load()
    # start the JVM's paths once; the timed runs below are single cold runs of each query
    QUERIES["e11_counter_top"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in HEADLINE:
        start = time.time()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
