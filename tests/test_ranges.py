"""First points and totals of intervals against a plain loop, and their plans: no list of (point, interval) pairs."""

from __future__ import annotations

import numpy as np
import pytest

from matchflow.operators import segment as sg
from matchflow.operators.intervals import range_join, range_totals
from matchflow.operators.ordered import Blocks
from pyspark.sql import functions as F

BLOCKS = Blocks.every(500)


@pytest.fixture(scope="module")
def rows():
    """Points that share times and names, intervals from empty to nearly all points, twice and without a key or an end."""
    rng = np.random.default_rng(5)
    points = [(int(rng.integers(0, 2)), int(t), i // 2, float(rng.random()) if i % 9 else None, float(rng.normal())) for i, t in enumerate(rng.integers(0, 3000, 700))]
    spans = [(int(rng.integers(0, 2)), i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-200, 3200, 60), [0, 3, 40, 400, 2900, -5] * 10))]
    spans += [spans[4], spans[5], (None, 90, 0, 3000), (0, 91, None, 3000), (1, None, 5, 2000), (1, None, 900, 2500)]
    points += [(None, 5, 1, 1.0, 1.0), (1, None, 2, 1.0, 1.0)]
    return points, spans


def inside(points, spans):
    """Points of every id, each once for every row of the id that holds it."""
    out = {}
    for m, i, lo, hi in spans:
        if m is not None and lo is not None:
            out.setdefault((m, i), []).extend(p for p in points if p[0] == m and p[1] is not None and lo <= p[1] <= hi)
    return {k: v for k, v in out.items() if v}


def frames(spark, rows):
    return (spark.createDataFrame(rows[0], "m int, t long, id int, v double, w double"), spark.createDataFrame(rows[1], "m int, seq int, lo long, hi long"))


@pytest.mark.parametrize("fold", [2, 64])
def test_range_totals(spark, rows, monkeypatch, fold):
    monkeypatch.setattr("matchflow.operators.intervals.FOLD", fold)
    points, spans = frames(spark, rows)
    known = F.col("v").isNotNull().cast("long")
    got = range_totals(points, spans, ["m"], ["seq"], "t", "lo", "hi", ["id"], ["t", "id"], {"n": F.lit(1).cast("long"), "known": known},
                       {"s": F.coalesce("v", F.lit(0.0))}, {"top": F.col("w")}, BLOCKS).collect()
    want = inside(*rows)
    assert {(r["m"], r["seq"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        held = want[r["m"], r["seq"]]
        assert (r["n"], r["known"], r["top"]) == (len(held), sum(p[3] is not None for p in held), max(p[4] for p in held))
        assert r["s"] == pytest.approx(sum(p[3] or 0 for p in held))
        assert tuple(r["first"]) == min((p[1], p[2]) for p in held) and tuple(r["last"]) == max((p[1], p[2]) for p in held)


def test_no_points(spark, rows):
    points, spans = frames(spark, rows)
    none = {"s": F.lit(0.0)}
    assert range_totals(points.where("false"), spans, ["m"], ["seq"], "t", "lo", "hi", ["id"], ["id"], {"n": F.lit(1).cast("long")}, none, {}, BLOCKS).count() == 0


def test_first_of_range(spark, rows):
    points, spans = frames(spark, rows)
    got = range_join(points, spans, ["m"], "t", "lo", "hi", 100, first="id", blocks=BLOCKS).groupBy("m", "seq").agg(F.min(F.struct("t", "id")).alias("p")).collect()
    want = {k: min((p[1], p[2]) for p in v) for k, v in inside(*rows).items()}
    assert {(r["m"], r["seq"]): tuple(r["p"]) for r in got} == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sequence_metrics_list_no_pairs(spark, rows):
    points = spark.createDataFrame(rows[0], "match_id int, match_time long, frame int, ball_speed double, ball_x_m double").withColumn("period", F.lit(0))
    points = points.withColumns({"ball_y_m": F.col("ball_x_m") + 1, "ball_x_norm": F.col("ball_x_m") * 2, "ball_y_norm": F.lit(1.0)})
    seqs = spark.createDataFrame(rows[1], "match_id int, cand_id int, start_ms long, end_ms long").withColumn("period", F.lit(0))
    out = sg.sequence_metrics(seqs, points)
    assert "__bucket" not in plan(out)
    want = {k: v for k, v in inside(*rows).items() if len(v) >= 2}
    got = out.collect()
    assert {(r["match_id"], r["cand_id"]): r["n_frames"] for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        speeds = [p[3] for p in want[r["match_id"], r["cand_id"]] if p[3] is not None]
        assert r["mean_speed"] == (pytest.approx(np.mean(speeds)) if speeds else None)


def test_first_pass_lists_no_pairs(spark):
    from matchflow.queries.q_segment import QUERIES
    assert "__bucket" not in plan(QUERIES["first_pass"](spark, "/root/testdata/sf0.001"))
