"""Published versions are seen together or not at all; failed matches are tried again; chosen matches and force."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from matchflow.plans import landing as plan
from matchflow.sources import writers as wr
from season import write_season


def rows(spark, folder, name):
    found = wr.read_output(spark, folder, name)
    return None if found is None else sorted(tuple(r) for r in found.select("v", "match_id").collect())


def test_a_failure_between_two_tables_leaves_the_old_state(spark, tmp_path):
    gold = str(tmp_path)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "v string, match_id long")
    assert wr.read_output(spark, gold, "one") is None
    wr.publish({"one": df, "two": df}, gold, df)
    new = df.withColumn("v", F.upper("v"))
    broken = new.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        wr.publish({"one": new, "two": broken}, gold, df)
    assert rows(spark, gold, "one") == rows(spark, gold, "two") == [("a", 1), ("b", 2)]
    # one match anew: the other stays, and a table without rows of it has none
    wr.publish({"one": new.where("match_id = 2"), "two": new.where("false")}, gold, df.where("match_id = 2"))
    assert rows(spark, gold, "one") == [("B", 2), ("a", 1)] and rows(spark, gold, "two") == [("a", 1)]
    wr.publish({"one": df.where("match_id = 2")}, gold, df.where("match_id = 2"))
    assert rows(spark, gold, "one") == [("a", 1), ("b", 2)] and rows(spark, gold, "two") == [("a", 1)]


@pytest.fixture
def landing(tmp_path):
    made = write_season(str(tmp_path / "made"), seconds=5)
    folder = tmp_path / "landing"
    for m in (1, 2):
        for feed, end in (("tracking", "tracking_poseedor"), ("events", "eventing")):
            (folder / feed).mkdir(parents=True, exist_ok=True)
            shutil.copy(f"{made[feed]}/partido_{m}_{end}.csv", folder / feed)
    return str(folder)


def test_failed_matches_are_tried_again(spark, landing, tmp_path):
    gold, fault, tried = str(tmp_path / "gold"), [True], []

    def tables(tracking, events, sequences):
        ids = sorted(r["match_id"] for r in tracking.select("match_id").distinct().collect())
        tried.append(ids)
        if 2 in ids and fault[0]:
            raise OSError("executor lost")
        return {"counts": tracking.groupBy("match_id").agg(F.count("*").alias("n"))}

    def run(**how):
        return plan.process_landed(spark, landing, gold, str(tmp_path / "progress"), tables=tables, **how)

    with pytest.raises(plan.LandingFailed) as failed:
        run(strict=True)
    assert [m for m, _ in failed.value.matches] == [2] and "executor lost" in str(failed.value)
    assert tried == [[1, 2], [1], [2]]
    assert [(r["match_id"], "executor lost" in r["error"]) for r in plan.failed_matches(spark, gold).collect()] == [(2, True)]
    assert sorted(r["match_id"] for r in wr.read_output(spark, gold, "counts").collect()) == [1]
    # the same fault again: recorded again, without an error
    tried.clear()
    run()
    assert tried == [[2]] and plan.failed_matches(spark, gold).count() == 1
    # the fault has passed: the match is done and its record cleared, and nothing is left to do
    fault[0] = False
    tried.clear()
    run(strict=True)
    run(strict=True)
    assert tried == [[2]] and plan.failed_matches(spark, gold).count() == 0
    assert sorted(r["match_id"] for r in wr.read_output(spark, gold, "counts").collect()) == [1, 2]
    # matches by name, and all of them
    tried.clear()
    assert run(matches=[1, 77]) is None and run(matches=[77]) is None
    run(force=True)
    assert tried == [[1], [1, 2]]
    assert wr.read_output(spark, gold, "counts").count() == 2
