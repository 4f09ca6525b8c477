"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from vigil import plans

HEADLINE = ["boundary_events", "tripwire_events", "crowd_events", "alert_cooldown", "fire_alarm_gap", "identity_nearest", "zone_membership", "recent_alerts", "alert_summary", "iou_pairs", "nms_class_aware", "precision_recall", "snapshot_nearest", "track_stability"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = plans.queries(), {}
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "rows_per_s": {n: round(events / took[n]) for n in ("boundary_events", "alert_cooldown", "crowd_events") if took[n]}}))
    spark.stop()


if __name__ == "__main__":
    main()
