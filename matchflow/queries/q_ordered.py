"""Ordered, as-of, interval and resampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import tracking as tr
from ..operators.ordered import Blocks
from ..operators.quantiles import percentile_table
from ..operators.resample import resample
from .adapter import HOUR, INTERVALS_SQL, METRES_SQL, TRACKING_SQL, blocks, intervals, metres, r6, table, tracking

QUERIES, SQL = {}, {}


def _downsample(spark, sf):
    t = tracking(spark, sf).selectExpr("*", "CASE WHEN frame % 3 = 0 THEN NULL ELSE value END AS v_some",
                                       "CASE WHEN frame % 5 = 0 THEN 'bad' ELSE CAST(value AS STRING) END AS v_text")
    out = tr.downsample(t, bucket_ms=6 * HOUR, first=["match_time", "frame", "team_id", "x", "y", "v_some", "v_text"],
                        numeric=["v_text"])
    return out.select("match_id", "period", "player_id", "bucket", "match_time", "frame", "team_id", r6("x"), r6("y"),
                      "v_some", "v_text")


QUERIES["downsample_first_non_null"] = _downsample


def _first(c):
    return f"arg_min({c}, match_time * 1000000000 + frame) FILTER (WHERE {c} IS NOT NULL) AS {c}"


SQL["downsample_first_non_null"] = f"""
WITH t AS (SELECT *, CASE WHEN frame % 3 = 0 THEN NULL ELSE value END AS v_some,
  TRY_CAST(CASE WHEN frame % 5 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v_text
  FROM ({TRACKING_SQL}))
SELECT match_id, period, player_id, match_time // {6 * HOUR} AS bucket, {_first('match_time')}, {_first('frame')},
  {_first('team_id')}, {_first('v_some')}, {_first('v_text')},
  round(arg_min(x, match_time * 1000000000 + frame), 6) AS x, round(arg_min(y, match_time * 1000000000 + frame), 6) AS y
FROM t GROUP BY ALL"""


def _player_kinematics(spark, sf):
    t = tracking(spark, sf)
    k = tr.player_kinematics(t, blocks(spark, sf), length=102.0 * 1e6, width=64.0 * 1e6)
    return k.select("match_id", "player_id", "period", "match_time", r6("dt_s"), F.round("dx_m", 3).alias("dx_m"),
                    F.round("dy_m", 3).alias("dy_m"), F.round("step_m", 3).alias("step_m"),
                    r6("speed"), r6("direction"), r6("speed_smooth"))


QUERIES["player_kinematics"] = _player_kinematics
SQL["player_kinematics"] = f"""
WITH t AS (SELECT *, x * 102000000.0::DOUBLE AS x_m, y * 64000000.0::DOUBLE AS y_m FROM ({TRACKING_SQL})),
l AS (SELECT *, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy,
  (match_time - lag(match_time) OVER w) / 1000.0::DOUBLE AS dt
  FROM t WINDOW w AS (PARTITION BY match_id, player_id, period ORDER BY match_time, frame)),
s AS (SELECT *, sqrt(dx * dx + dy * dy) AS st,
  CASE WHEN dt > 0 THEN least(sqrt(dx * dx + dy * dy) / dt, 12.0::DOUBLE) END AS sp FROM l)
SELECT match_id, player_id, period, match_time, round(dt, 6) AS dt_s, round(dx, 3) AS dx_m, round(dy, 3) AS dy_m,
  round(st, 3) AS step_m, round(sp, 6) AS speed, round(atan2(dy, dx), 6) AS direction,
  round(avg(sp) OVER (PARTITION BY match_id, player_id, period ORDER BY match_time, frame
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS speed_smooth FROM s"""


def _ball_kinematics(spark, sf):
    t = metres(tracking(spark, sf))
    k = tr.ball_kinematics(t, blocks(spark, sf))
    return k.select("match_id", "period", "frame", "player_id", r6("ball_speed"), r6("ball_direction"), r6("ball_dist_m"))


QUERIES["ball_kinematics"] = _ball_kinematics
SQL["ball_kinematics"] = f"""
WITH t AS ({METRES_SQL}),
l AS (SELECT *, ball_x_m - lag(ball_x_m) OVER w AS dx, ball_y_m - lag(ball_y_m) OVER w AS dy,
  (match_time - lag(match_time) OVER w) / 1000.0::DOUBLE AS dt
  FROM t WINDOW w AS (PARTITION BY match_id, period ORDER BY match_time, frame))
SELECT match_id, period, frame, player_id, round(CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt END, 6) AS ball_speed,
  round(atan2(dy, dx), 6) AS ball_direction,
  round(sqrt((x_m - ball_x_m) * (x_m - ball_x_m) + (y_m - ball_y_m) * (y_m - ball_y_m)), 6) AS ball_dist_m FROM l"""


def _asof_nearest(spark, sf):
    t = tracking(spark, sf)
    left = t.where("event_type = 'error'").select("match_id", "period", "player_id", "frame", "match_time")
    right = t.where("event_type = 'view'").select("match_id", "period", "player_id", "frame", "match_time", "x", "y")
    out = iv.asof(left, right, ["match_id", "period", "player_id"], "match_time", "match_time", ["frame", "x", "y"],
                  blocks(spark, sf), direction="nearest", tolerance=6 * HOUR, tie=F.col("frame"), how="inner")
    return out.select("match_id", "period", "player_id", "frame", "match_time", "m_frame",
                      F.col("m_time").cast("long").alias("m_time"), r6("m_x"), r6("m_y"))


QUERIES["asof_nearest_tolerance"] = _asof_nearest
SQL["asof_nearest_tolerance"] = f"""
WITH t AS ({TRACKING_SQL}),
p AS (SELECT l.match_id, l.period, l.player_id, l.frame, l.match_time, r.frame AS m_frame, r.match_time AS m_time,
  r.x AS m_x, r.y AS m_y, row_number() OVER (PARTITION BY l.frame ORDER BY abs(r.match_time - l.match_time),
    r.match_time, r.frame) AS rn
  FROM t l JOIN t r ON l.player_id = r.player_id AND l.period = r.period AND l.match_id = r.match_id
   AND abs(r.match_time - l.match_time) <= {6 * HOUR}
  WHERE l.event_type = 'error' AND r.event_type = 'view')
SELECT match_id, period, player_id, frame, match_time, m_frame, m_time, round(m_x, 6) AS m_x, round(m_y, 6) AS m_y
FROM p WHERE rn = 1"""


def _exists(spark, sf):
    t = tracking(spark, sf).select("match_id", "period", "frame", "match_time", "event_type")
    out = iv.exists_within(t.where("event_type = 'purchase'"), t.where("event_type = 'signup'"),
                           ["match_id", "period"], "match_time", "match_time", HOUR, blocks(spark, sf), "found")
    return out.select("match_id", "period", "frame", F.col("found").cast("int").alias("found"))


QUERIES["exists_in_window"] = _exists
SQL["exists_in_window"] = f"""
WITH t AS ({TRACKING_SQL})
SELECT match_id, period, frame, CASE WHEN EXISTS (SELECT 1 FROM t s WHERE s.event_type = 'signup'
  AND s.match_id = p.match_id AND s.period = p.period AND abs(s.match_time - p.match_time) <= {HOUR})
  THEN 1 ELSE 0 END AS found FROM t p WHERE event_type = 'purchase'"""


def _nearest_interval(spark, sf):
    pts = tracking(spark, sf).where("event_type = 'error'").select("match_id", "period", "frame", "match_time")
    out = iv.nearest_interval(pts, intervals(spark, sf), ["match_id", "period"], "match_time", "start_ms", "end_ms",
                              ["seq_id"], blocks(spark, sf), tolerance=12 * HOUR, tie="seq_id")
    label = F.when(F.col("m_gap") == 0, "dentro_intervalo").when(F.col("m_gap") > 0, "tiro_cercano_a_intervalo")
    return out.select("match_id", "period", "frame", F.col("m_seq_id").alias("seq_id"),
                      F.col("m_gap").cast("long").alias("gap"), label.alias("kind"))


QUERIES["nearest_interval"] = _nearest_interval
SQL["nearest_interval"] = f"""
WITH t AS ({TRACKING_SQL}), i AS ({INTERVALS_SQL}),
c AS (SELECT t.match_id, t.period, t.frame, i.seq_id, end_ms - start_ms AS len,
  CASE WHEN match_time < start_ms THEN start_ms - match_time WHEN match_time > end_ms THEN match_time - end_ms
    ELSE 0 END AS gap
  FROM t JOIN i ON t.match_id = i.match_id AND t.period = i.period
    AND match_time BETWEEN start_ms - {12 * HOUR} AND end_ms + {12 * HOUR} WHERE event_type = 'error'),
b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY gap, len DESC, seq_id) AS rn FROM c)
SELECT t.match_id, t.period, t.frame, b.seq_id, b.gap,
  CASE WHEN gap = 0 THEN 'dentro_intervalo' WHEN gap > 0 THEN 'tiro_cercano_a_intervalo' END AS kind
FROM t LEFT JOIN b ON t.frame = b.frame AND rn = 1 WHERE event_type = 'error'"""


def _last_wins(spark, sf):
    pts = tracking(spark, sf).select("match_id", "period", "frame", "match_time")
    out = iv.best_covering(pts, intervals(spark, sf), ["match_id", "period"], "match_time", "start_ms", "end_ms",
                           [F.col("seq_id")], ["seq_id"], blocks(spark, sf))
    return out.select("match_id", "period", "frame", F.col("m_seq_id").alias("seq_id"))


QUERIES["point_in_interval_last_wins"] = _last_wins
SQL["point_in_interval_last_wins"] = f"""
WITH t AS ({TRACKING_SQL}), i AS ({INTERVALS_SQL})
SELECT t.match_id, t.period, t.frame, max(i.seq_id) AS seq_id FROM t LEFT JOIN i
  ON t.match_id = i.match_id AND t.period = i.period AND match_time BETWEEN start_ms AND end_ms
GROUP BY ALL"""


def _resample_index(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    out = resample(e, ["vec_id", "label"], ["pos"], {"v": F.col("v")}, 20, Blocks.every(1 << 20))
    return out.select("vec_id", "n_rows", F.posexplode("v").alias("point", "v")).select(
        "vec_id", "n_rows", "point", r6("v"))


QUERIES["resample_index"] = _resample_index
SQL["resample_index"] = """
WITH e AS (SELECT vec_id, len(embedding) AS n, embedding FROM embeddings),
p AS (SELECT vec_id, n, embedding, j, j * (n - 1) / 19.0::DOUBLE AS a FROM e, range(20) r(j)),
q AS (SELECT *, CAST(floor(a) AS BIGINT) AS f FROM p)
SELECT vec_id, n AS n_rows, j AS point, round(embedding[f + 1]::DOUBLE + (a - f) *
  (embedding[least(f + 2, n)]::DOUBLE - embedding[f + 1]::DOUBLE), 6) AS v FROM q"""


def _resample_time(spark, sf):
    t = tracking(spark, sf)
    out = resample(t, ["match_id", "period", "player_id"], ["match_time"], {"v": F.col("value")}, 20,
                   blocks(spark, sf), by="time", min_points=3)
    return out.select("match_id", "period", "player_id", "n_rows", F.posexplode("v").alias("point", "v")).select(
        "match_id", "period", "player_id", "n_rows", "point", F.round("v", 4).alias("v"))


QUERIES["resample_time"] = _resample_time
SQL["resample_time"] = f"""
WITH t AS ({TRACKING_SQL}),
s AS (SELECT match_id, period, player_id, count(*) AS n, min(match_time) AS t0, max(match_time) AS t1 FROM t
  GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT *, t0 + (t1 - t0) * (j / 19.0::DOUBLE) AS tgt FROM s, range(20) r(j)),
w AS (SELECT g.*, (SELECT struct_pack(a := max(match_time), v := arg_max(value, match_time)) FROM t
    WHERE t.match_id = g.match_id AND t.period = g.period AND t.player_id = g.player_id AND match_time <= tgt + 1e-6) AS lo,
  (SELECT struct_pack(a := min(match_time), v := arg_min(value, match_time)) FROM t
    WHERE t.match_id = g.match_id AND t.period = g.period AND t.player_id = g.player_id AND match_time >= tgt - 1e-6) AS hi
  FROM g)
SELECT match_id, period, player_id, n AS n_rows, j AS point, round(CASE WHEN hi.a <= lo.a THEN lo.v
  ELSE lo.v + (hi.v - lo.v) * (tgt - lo.a) / (hi.a - lo.a) END, 4) AS v FROM w"""


def _percentiles(spark, sf):
    o = table(spark, sf, "orders").withColumn("half", F.col("o_totalprice") / 2)
    out = percentile_table(o, ["o_orderpriority"], ["o_totalprice", "half"], [0.0, 0.1, 0.5, 0.9, 1.0])
    return out.select("o_orderpriority", *[r6(c) for c in out.columns[1:]])


QUERIES["percentiles_exact"] = _percentiles
SQL["percentiles_exact"] = "SELECT o_orderpriority, " + ", ".join(
    f"round(quantile_cont({c}, {p / 1000}), 6) AS {n}_p{p}" for c, n in (("o_totalprice", "o_totalprice"),
    ("o_totalprice / 2", "half")) for p in (0, 100, 500, 900, 1000)) + " FROM orders GROUP BY 1"
