"""Landed files to gold: only new files are opened, failing matches are recorded."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from matchflow.plans.landing import process_landed
from season import write_season


def test_only_new_files(spark, tmp_path):
    made = write_season(str(tmp_path / "made"), seconds=5)
    landing, gold = tmp_path / "landing", str(tmp_path / "gold")
    opened = []

    def tables(tracking, events, sequences, **how):
        opened.append(sorted(f.rsplit("/", 1)[1] for df in (tracking, events) for f in df.inputFiles()))
        ids = [r["match_id"] for r in tracking.select("match_id").distinct().collect()]
        if 2 in ids:
            raise ValueError("match 2 cannot be read")
        return {"counts": tracking.groupBy("match_id").agg(F.count("*").alias("n"))}

    for m in (1, 2, 3):
        for feed, end in (("tracking", "tracking_poseedor"), ("events", "eventing"), ("sequences", "sequences")):
            (landing / feed).mkdir(parents=True, exist_ok=True)
            if m < 3 or feed != "sequences":
                shutil.copy(f"{made[feed]}/partido_{m}_{end}.csv", landing / feed)
        if m != 2:
            process_landed(spark, str(landing), gold, str(tmp_path / "progress"), tables=tables)
    names = [f"partido_{m}_{end}.csv" for m in (1, 2, 3) for end in ("tracking_poseedor", "eventing")]
    assert opened[0] == sorted(names[:2])
    assert opened[1] == sorted(names[2:])  # the second run opens nothing of match 1
    assert opened[2:] == [sorted(names[2:4]), sorted(names[4:])]
    assert sorted(r["match_id"] for r in spark.read.parquet(f"{gold}/counts").collect()) == [1, 3]
    failed = spark.read.parquet(f"{gold}/failed").collect()
    assert [(r["match_id"], "match 2 cannot be read" in r["error"]) for r in failed] == [(2, True)]
