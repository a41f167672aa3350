"""Recalibration against a plain sequential model that edits one table event by event."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from matchflow.operators import align
from season import make_match

SPAN = np.array([102.0, 64.0])


def sequential(track: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """Whole-table model: one event after the other, every edit visible to the next one."""
    df = track.sort_values(["match_id", "period", "match_time", "frame", "player_id"]).reset_index(drop=True)
    xy, ball = df[["x", "y"]].to_numpy(float).copy(), df[["ball_x", "ball_y"]].to_numpy(float).copy()
    t = df.match_time.to_numpy(float)

    def frame_rows(i):
        return np.flatnonzero((df.match_id == df.match_id[i]) & (df.period == df.period[i]) & (df.frame == df.frame[i]))

    for ev in events.sort_values("event_no").itertuples():
        here = ((df.match_id == ev.match_id) & (df.period == ev.period)).to_numpy()
        own = np.flatnonzero(here & (df.player_id == ev.player_id).to_numpy())
        target = np.array([ev.x, ev.y])
        if ev.setpiece_type == "throwin":
            seen = {}
            for i in np.flatnonzero(here):
                seen.setdefault(df.frame[i], i)
            line = [i for i in sorted(seen.values(), key=lambda i: t[i]) if t[i] <= ev.match_time]
            known = [not np.isnan(ball[i]).any() for i in line]
            out, run = None, 0
            for k in range(len(line)):
                run = 0 if known[k] else run + 1
                if run == 3 and k - 3 >= 0:
                    out = t[line[k - 3]]
            fallback = max(t[own].min(), ev.match_time - 4000)
            out = fallback if out is None or ev.match_time - out < 2500 else out
            hold, stop = out + 0.45 * (ev.match_time - out), ev.match_time + 3000
            for i in own[(t[own] >= out) & (t[own] <= stop)]:
                if t[i] <= hold:
                    w = min(max((t[i] - out) / max(1, hold - out), 0), 1) ** 0.65
                elif t[i] <= ev.match_time:
                    w = 0.985
                else:
                    w = 0.985 * (1 - (t[i] - ev.match_time) / 3000) ** 0.55
                xy[i] = (1 - w) * xy[i] + w * target
                if t[i] <= ev.match_time:
                    ball[frame_rows(i)] = target
            continue
        a = int(np.argmin(np.abs(t[own] - ev.match_time)))
        d = target - xy[own[a]]
        if np.hypot(*(d * SPAN)) <= 0.25:
            continue
        kick = ev.setpiece_type in ("goalkick", "freekick")
        n = min(a, 4)
        before = [0.30, 0.50, 0.70, 0.85, 0.97][5 - n:] if kick else [(k / n) ** 0.6 for k in range(1, n + 1)]
        after = [0.95, 0.85, 0.70, 0.50][:len(own) - 1 - a]
        for i, w in zip(own[a - n:a + 1 + len(after)], before + [1.0] + after):
            xy[i] += w * d
            rows = frame_rows(i)
            if np.isnan(ball[rows[0]]).any() or (kick and w != 1.0):
                continue
            share = 0.98 if kick else 0.90 if w == 1.0 else 0.35 if t[i] < ev.match_time else 0.20
            ball[rows] = (1 - share) * ball[rows[0]] + share * xy[i]
    df[["x", "y"]], df[["ball_x", "ball_y"]] = np.clip(xy, 0, 1), np.clip(ball, 0, 1)
    return df


@pytest.mark.parametrize("dense, block_rows", [(False, 1 << 14), (True, 1 << 14), (True, 6)])
def test_recalibration(spark, dense, block_rows):
    """Blocks of six rows are shorter than a window: shifts reach over every border, whatever the order of the events."""
    track, events, _ = make_match(1, 99, seconds=40)
    keep = ["match_id", "period", "frame", "match_time", "player_id", "x", "y", "ball_x", "ball_y"]
    track = track[keep].drop_duplicates(["match_id", "period", "frame", "player_id"])
    rng = np.random.default_rng(4)
    ev = events.rename(columns={"period_order": "period", "event_time": "match_time"})[["match_id", "period", "player_id", "match_time", "x", "y"]]
    ev = ev.sample(60 if dense else 4, replace=dense, random_state=3).sort_values(["period", "match_time"]).reset_index(drop=True)
    ev[["x", "y"]] = np.clip(ev[["x", "y"]] + rng.normal(0, 0.1, (len(ev), 2)), 0, 1)
    kinds = ["throwin", "goalkick", None, None] if dense else [None, "goalkick"]
    ev["setpiece_type"] = (kinds * len(ev))[:len(ev)]
    # longer stretches without a ball, so that throw-ins compete for them
    lost = (track.match_time % 9000).between(2000, 4000)
    track.loc[lost, ["ball_x", "ball_y"]] = np.nan
    ev["event_no"] = np.arange(len(ev)) if block_rows > 6 else rng.permutation(len(ev))
    want = sequential(track, ev)
    df = spark.createDataFrame(track.astype({"match_time": "float64"}).replace({np.nan: None}))
    got = align.apply_recalibration(df, spark.createDataFrame(ev.astype({"match_time": "float64"}).astype(object).where(ev.notna(), None),
                                    "match_id long, period long, player_id long, match_time double, x double, y double, setpiece_type string, event_no long"),
                                    block_rows=block_rows).toPandas()
    order = ["match_id", "period", "match_time", "frame", "player_id"]
    got, want = got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("x", "y", "ball_x", "ball_y"):
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True, atol=1e-9), c
    assert not np.allclose(want.x, track.sort_values(order).x)


def test_tied_throw_ins_and_log(spark):
    """Two throw-ins at one millisecond: the default order gives them numbers of their own, each is applied and logged once."""
    rows = [(1, 0, p, 10 * k + p, 1000 * k, 0.2 + 0.01 * p, 0.3, 0.5, 0.5, p % 2) for k in range(30) for p in (1, 2)]
    tracking = spark.createDataFrame(rows, "match_id long, period long, player_id long, frame long, match_time long, x double, y double, ball_x double, "
                                           "ball_y double, team_id long")
    events = spark.createDataFrame([(1, 0, p, 15_000, 0.9, 0.9 - 0.1 * p, "throwin", p % 2) for p in (1, 2)],
                                   "match_id long, period long, player_id long, match_time long, x double, y double, setpiece_type string, team_id long")
    once = align.apply_recalibration(tracking, events.withColumn("event_no", F.col("player_id")))
    out = align.recalibrate(tracking, events)
    assert out.count() == len(rows)
    want = {(r["player_id"], r["match_time"]): (round(r["x"], 9), round(r["y"], 9), round(r["ball_x"], 9)) for r in once.collect()}
    assert {(r["player_id"], r["match_time"]): (round(r["x"], 9), round(r["y"], 9), round(r["ball_x"], 9)) for r in out.collect()} == want
    log = align.apply_with_log(tracking, events.withColumn("event_no", F.col("player_id")))[1].orderBy("event_no").collect()
    assert [(r["event_no"], r["mode"], r["anchor_ms"], r["stop_ms"]) for r in log] == [(1, "throwin", 15000, 18000), (2, "throwin", 15000, 18000)]
    assert all(abs(r["dx"] - (0.9 - 0.2 - 0.01 * r["player_id"])) < 1e-9 and r["error_m"] > 60 for r in log)


def plain_outs(t, known, asked, rules):
    """Frame by frame: each throw-in looks at all frames so far and puts the ball back into those since its out time."""
    t, open_ = np.asarray(t, float), ~np.asarray(known)
    prev = np.r_[np.nan, t[:-1]]
    outs = {}
    for no, when, first in sorted(asked):
        seen = np.flatnonzero(open_ & (t <= when))
        runs = [r for r in np.split(seen, np.flatnonzero(np.diff(seen) != 1) + 1) if len(r) >= rules.null_run and not np.isnan(prev[r[0]])]
        back = max(first, when - rules.throw_back_ms)
        out = prev[runs[-1][0]] if runs else back
        out = back if when - out < rules.throw_min_ms else out
        open_ &= ~((t >= out) & (t <= when))
        outs[no] = out
    return outs


@pytest.mark.parametrize("frames, throws, in_order", [(60_000, 10_000, True), (4_000, 1_500, False)])
def test_throw_in_outs_of_one_period(spark, frames, throws, in_order):
    rng = np.random.default_rng(7)
    known = np.repeat(rng.random(frames) < 0.5, rng.integers(1, 9, frames))[:frames]
    t = np.cumsum(rng.integers(40, 200, frames))
    when = rng.integers(0, t[-1] + 500, throws)
    if in_order:
        when.sort()
    asked = [(no, float(w), float(rng.choice([0, max(0, w - 1500)]))) for no, w in enumerate(when.tolist())]
    import pandas as pd
    line = spark.createDataFrame(pd.DataFrame({"match_id": 1, "period": 0, "frame": np.arange(frames), "match_time": t.astype(float),
                                               "ball_x": np.where(known, 0.5, np.nan), "ball_y": 0.5}))
    line = line.withColumn("ball_x", F.nanvl("ball_x", F.lit(None).cast("double")))
    throwins = spark.createDataFrame([(1, 0, *a) for a in asked], "match_id long, period long, event_no long, match_time double, first_ms double")
    rules = align.AlignRules()
    got = {r["event_no"]: r["out_ms"] for r in align.ball_outs(line, throwins, rules).collect()}
    assert got == plain_outs(t, known, asked, rules)


@pytest.mark.parametrize("block_rows", [1 << 14, 9])
def test_all_events_query(spark, block_rows):
    """The registered query on every event of the stream, whole and in short blocks, against the sequential model."""
    from matchflow.queries import q_outputs
    sf = "/root/testdata/sf0.001"
    t, events = q_outputs.dense_inputs(spark, sf)
    track, ev = t.toPandas().astype({"match_time": "float64"}), events.toPandas()
    ev = ev.sort_values(["match_id", "period", "event_no"])
    want = sequential(track, ev).set_index(["match_id", "period", "frame"]).sort_index()
    if block_rows > 9:
        got = q_outputs.QUERIES["recalibrate_dense"](spark, sf).toPandas()
        assert got["mode"].notna().sum() == len(ev)
    else:
        got = align.apply_recalibration(t, events, blocks=q_outputs.blocks(spark, sf), block_rows=block_rows).toPandas()
    got = got.set_index(["match_id", "period", "frame"]).sort_index()
    assert len(got) == len(want)
    for c in ("x", "y", "ball_x", "ball_y"):
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True, atol=2e-6), c


def test_throw_in_outs_query(spark):
    from matchflow.queries import q_outputs
    sf = "/root/testdata/sf0.001"
    t, events = q_outputs.dense_inputs(spark, sf)
    t, throws = q_outputs.lost_ball(t).toPandas(), events.where("setpiece_type = 'throwin'").toPandas()
    rules = align.AlignRules(throw_back_ms=q_outputs.HOUR, throw_min_ms=q_outputs.HOUR // 2)
    want = {}
    for (m, p), line in t.sort_values(["match_time", "frame"]).groupby(["match_id", "period"]):
        first = line.groupby("player_id").match_time.min()
        mine = throws[(throws.match_id == m) & (throws.period == p)]
        outs = plain_outs(line.match_time, line.ball_x.notna() & line.ball_y.notna(), [(r.event_no, r.match_time, first[r.player_id]) for r in mine.itertuples()], rules)
        want |= {(m, p, no): out for no, out in outs.items()}
    got = {(r[0], r[1], r[2]): r[3] for r in q_outputs.QUERIES["throw_in_outs"](spark, sf).collect()}
    assert got == want and len(got) > 20


def test_replay_of_many_players_in_one_call(spark):
    """Blocks of many players go to Python together: the same places as each block alone, and no call for each player."""
    import pandas as pd
    rng = np.random.default_rng(3)
    rows = []
    for player in range(12):
        base = rng.random((30, 2))
        for no in rng.permutation(9)[:rng.integers(1, 9)].tolist():
            a, throw, goal = int(rng.integers(0, 30)), bool(rng.random() < 0.3), rng.random(2)
            own = bool(rng.random() < 0.8)
            rows += [(1, 0, player, 0, no, r, a if own else 99, own, throw, rng.random(), *goal, *base[r], 0.1, -0.1, not own) for r in range(max(0, a - 4), min(30, a + 5))]
    ops = pd.DataFrame(rows, columns="match_id period player_id block event_no rank a_rank own throw w tx ty x0 y0 gx gy shown".split()).sample(frac=1, random_state=1)
    place = ["match_id", "period", "player_id", "block", "event_no", "rank"]
    alone = pd.concat([align._replay(g, align.AlignRules()) for _, g in ops.groupby("player_id")]).sort_values(place).reset_index(drop=True)
    pd.testing.assert_frame_equal(align._replay(ops, align.AlignRules()).sort_values(place).reset_index(drop=True), alone, check_exact=True)
    # one event by hand: (the goal less the anchor's place) times the weight
    one = ops[ops.own & ~ops.throw]
    one = one[(one.player_id == one.player_id.iloc[0]) & (one.event_no == one.event_no.iloc[0])].sort_values("rank")
    at = one[one["rank"] == one.a_rank].iloc[0]
    got = align._replay(one, align.AlignRules()).sort_values("rank")
    assert np.allclose(got.x, one.x0 + one.w * (at.tx - at.x0)) and np.allclose(got.y, one.y0 + one.w * (at.ty - at.y0)) and got.moved.all()


def test_calls_of_replay_follow_rows_not_players(spark, tmp_path, monkeypatch):
    seen, plain = str(tmp_path), align._replay

    def counted(ops, rules):
        import uuid
        open(f"{seen}/{uuid.uuid4().hex}", "w").close()
        return plain(ops, rules)

    monkeypatch.setattr(align, "_replay", counted)
    tracking = spark.range(2000).selectExpr("1L AS match_id", "0L AS period", "id % 200 AS player_id", "id AS frame", "CAST(id * 40 AS DOUBLE) AS match_time",
                                            "0.2D AS x", "0.3D AS y", "0.5D AS ball_x", "0.5D AS ball_y")
    events = tracking.where("frame >= 1000 AND frame < 1200").selectExpr("match_id", "period", "player_id", "match_time", "0.4D AS x", "0.3D AS y",
                                                                         "CAST(NULL AS STRING) AS setpiece_type", "frame AS event_no")
    out = align.apply_recalibration(tracking, events).where("frame >= 1000 AND frame < 1200")
    assert out.where("abs(x - 0.4) < 1e-9").count() == 200
    assert 0 < len(list(tmp_path.iterdir())) <= 4
