"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from sensorloom.plans import catalog
from sensorloom.session import local_session

HEADLINE = (
    "column_profile_rows",
    "column_profile",
    "feature_mart",
    "rolling_z",
    "observation_id",
    "rolling_ooc_rate",
    "temporal_split",
    "stratified_split_events",
    "auc_metrics_events",
    "threshold_sweep",
    "stratified_bootstrap",
    "median_fit_rows",
    "spearman_edges",
    "sensor_correlation",
    "t2_q_score",
    "ooc_severity",
    "risk_coverage",
    "ks_two_sample",
    "era_drift",
    "linear_contributions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
