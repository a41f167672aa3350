"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from matchflow import queries as registered

HEADLINE = (
    "downsample_first_non_null", "player_kinematics", "ball_kinematics", "detect_possession", "asof_nearest_tolerance", "reference_event",
    "nearest_interval", "point_in_interval_last_wins", "extend_possession", "possession_blocks", "sequence_metrics", "recalibrate_single",
    "resample_time", "trajectories", "sequence_threat", "defensive_profile", "pitch_control", "percentile_category", "idd", "ipo", "pattern_table",
    "category_matrix", "chronology_windows", "taxonomy", "summary_metrics", "heatmap_bins", "standardise", "silhouette", "json_fields", "repair_text")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    every = registered.all_queries()
    # one run to start the JVM's code generation before anything is timed
    every["risk_summary"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
