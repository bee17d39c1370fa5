"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from contrail.registry import QUERIES

HEADLINE = (
    "s28_nearest_airport", "s33_positions_before", "s35_split_sessions", "s37_ground_transitions", "s42_session_features", "s43_detect_flights", "s51_incremental_detect", "s53_backfill_open_flights", "s54_replay_detector",
    "s60_upsert_flights", "s69_compare_fleets", "s86_top_routes", "s88_fleet_list", "s98_route_transitions", "s101_preceding_routes",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.local.dir", scratch).config("spark.sql.warehouse.dir", f"{scratch}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["s78_fleet_counts"](spark, sf_dir).collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
