"""Possession, key events, directions and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import mirror_fixed
from ..functions.jsontext import has_event, has_event_text
from ..operators import align, attack, events as evs, tracking as tr
from ..operators.ordered import Blocks, first_rows
from .adapter import HOUR, METRES_SQL, TRACKING_SQL, blocks, metres, r6, table, tracking

QUERIES, SQL = {}, {}

HOURLY_SQL = f"SELECT *, match_time // {HOUR} AS hour, sqrt((x - ball_x) * (x - ball_x) + (y - ball_y) * (y - ball_y)) AS dist_ball FROM ({TRACKING_SQL})"


def _hourly(spark, sf):
    t = tracking(spark, sf)
    d = F.sqrt((F.col("x") - F.col("ball_x")) * (F.col("x") - F.col("ball_x"))
               + (F.col("y") - F.col("ball_y")) * (F.col("y") - F.col("ball_y")))
    return t.withColumns({"hour": F.floor(F.col("match_time") / HOUR), "dist_ball": d})


def _nearest_possessor(spark, sf):
    out = tr.nearest_possessor(_hourly(spark, sf), F.lit(0), ("match_id", "period", "hour"), 0.2, "dist_ball", "frame")
    return out.select("match_id", "period", "hour", "frame", "player_id", "possessor", "possession_side")


QUERIES["nearest_possessor"] = _nearest_possessor
SQL["nearest_possessor"] = f"""
WITH t AS ({HOURLY_SQL}),
n AS (SELECT match_id, period, hour, arg_min(player_id, (dist_ball, frame)) AS p, arg_min(team_id, (dist_ball, frame)) AS tm,
  min(dist_ball) AS d FROM t GROUP BY ALL HAVING min(dist_ball) <= 0.2)
SELECT t.match_id, t.period, t.hour, frame, player_id, CASE WHEN player_id = p THEN 1 ELSE 0 END AS possessor,
  CASE WHEN tm = 0 THEN 'propia' WHEN tm IS NOT NULL THEN 'rival' END AS possession_side
FROM t LEFT JOIN n ON t.match_id = n.match_id AND t.period = n.period AND t.hour = n.hour"""

STATE = "CASE frame % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'away' WHEN 2 THEN 'neutral' END"


def _detect(spark, sf):
    t = metres(tracking(spark, sf)).selectExpr("*", "value / 100 AS speed_smooth", "CAST(frame % 7 AS DOUBLE) AS ball_speed",
                                               f"{STATE} AS ball_state")
    t = t.withColumn("ball_dist_m", F.sqrt(F.pow(F.col("x_m") - F.col("ball_x_m"), 2) + F.pow(F.col("y_m") - F.col("ball_y_m"), 2)))
    rules = tr.PossessionRules(candidate_m=30.0, clear_m=6.0, max_speed_gap=3.0)
    return tr.detect_possession(t, rules=rules).select("match_id", "frame", "team_side", "possessor")


QUERIES["detect_possession"] = _detect
SQL["detect_possession"] = f"""
WITH t AS (SELECT *, {STATE} AS st, sqrt((x_m - ball_x_m)**2 + (y_m - ball_y_m)**2) AS d,
  abs(value / 100 - (frame % 7)) AS g FROM ({METRES_SQL})),
f AS (SELECT match_id, team_id, min((period, frame, player_id)) AS k FROM t GROUP BY ALL),
s AS (SELECT match_id, team_id, CASE row_number() OVER (PARTITION BY match_id ORDER BY k)
  WHEN 1 THEN 'home' WHEN 2 THEN 'away' END AS team_side FROM f)
SELECT t.match_id, frame, team_side, CASE WHEN d <= 6 THEN 1
  WHEN d <= 30 AND g <= 3 AND team_side = coalesce(st, 'none') AND coalesce(st, 'none') <> 'none' THEN 1
  WHEN d <= 30 AND g <= 3 AND coalesce(st, 'none') = 'neutral' THEN 2 ELSE 0 END AS possessor
FROM t JOIN s ON t.match_id = s.match_id AND t.team_id = s.team_id"""


def _own_rival(spark, sf):
    return tr.own_and_rival(tracking(spark, sf))


QUERIES["own_and_rival"] = _own_rival
SQL["own_and_rival"] = f"""
WITH c AS (SELECT match_id, team_id, count(*) AS n, min((period, frame, player_id)) AS k FROM ({TRACKING_SQL}) GROUP BY ALL),
o AS (SELECT match_id, arg_min(team_id, (-n, team_id)) AS own_team FROM c GROUP BY 1)
SELECT o.match_id, own_team, arg_min(c.team_id, k) AS rival_team FROM o JOIN c ON o.match_id = c.match_id AND team_id <> own_team
GROUP BY ALL"""


def _frames(spark, sf):
    t = metres(_hourly(spark, sf)).selectExpr("*", "CASE WHEN frame % 5 = 0 THEN 1 ELSE 0 END AS possessor",
                                              "CAST(frame % 7 AS DOUBLE) AS ball_speed")
    t = t.withColumn("ball_x_m", F.when(F.col("frame") % 3 != 0, F.col("ball_x_m")))
    out = tr.frame_table(t, ("match_id", "period", "hour"))
    return out.select("match_id", "period", "hour", "match_time", r6("ball_x_m"), r6("ball_y_m"), "ball_speed", "possessing_team")


QUERIES["frame_table"] = _frames
SQL["frame_table"] = f"""
WITH t AS (SELECT *, ball_y * 64 AS ym, CASE WHEN frame % 3 <> 0 THEN ball_x * 102 END AS xm FROM ({HOURLY_SQL}))
SELECT match_id, period, hour, min(match_time) AS match_time,
  round(arg_min(xm, (match_time, player_id)) FILTER (WHERE xm IS NOT NULL), 6) AS ball_x_m,
  round(arg_min(ym, (match_time, player_id)), 6) AS ball_y_m,
  arg_min((frame % 7)::DOUBLE, (match_time, player_id)) AS ball_speed,
  arg_min(team_id, (match_time, player_id)) FILTER (WHERE frame % 5 = 0) AS possessing_team FROM t GROUP BY ALL"""

TYPED = """CASE event_type WHEN 'signup' THEN 'setpiece' WHEN 'purchase' THEN 'shot' WHEN 'view' THEN 'pass' ELSE event_type END"""


def _key_events(spark, sf):
    t = tracking(spark, sf).withColumns({
        "event_types": F.array(F.expr(TYPED)), "k": F.get_json_object("props", "$.k").try_cast("int")})
    t = t.withColumn("setpiece_type", F.when(F.col("k") < 40, "corner").when(F.col("k") < 60, "kickoff").when(F.col("k") < 80, "other"))
    return t.where(evs.is_key_event()).select("match_id", "frame", F.col("event_types")[0].alias("kind"), "setpiece_type")


QUERIES["key_events"] = _key_events
SQL["key_events"] = f"""
WITH t AS (SELECT *, {TYPED} AS kind, CAST(props->>'$.k' AS INT) AS k FROM ({TRACKING_SQL})),
s AS (SELECT *, CASE WHEN k < 40 THEN 'corner' WHEN k < 60 THEN 'kickoff' WHEN k < 80 THEN 'other' END AS setpiece_type FROM t)
SELECT match_id, frame, kind, setpiece_type FROM s WHERE kind IN ('setpiece', 'shot', 'pass')
  AND (kind <> 'setpiece' OR coalesce(setpiece_type IN ('corner', 'kickoff'), FALSE))"""


def _has_event(spark, sf):
    t = tracking(spark, sf).withColumn("types", F.array("event_type", F.upper("event_type")))
    return t.select("frame", has_event("types", {"view", "click"}).cast("int").alias("in_list"),
                    has_event_text("event_type", {"ew", "ick"}).cast("int").alias("in_text"))


QUERIES["has_event"] = _has_event
SQL["has_event"] = """SELECT event_id AS frame, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS in_list,
  CASE WHEN event_type LIKE '%ew%' OR event_type LIKE '%ick%' THEN 1 ELSE 0 END AS in_text FROM events"""


def _rescale(spark, sf):
    t = tracking(spark, sf).select("match_id", "frame", "x", "value")
    return evs.rescale_percent(t, ["x", "value"]).select("match_id", "frame", r6("x"), r6("value"))


QUERIES["rescale_percent"] = _rescale
SQL["rescale_percent"] = f"""SELECT match_id, frame,
  round(CASE WHEN max(x) OVER (PARTITION BY match_id) > 1.5 THEN x / 100 ELSE x END, 6) AS x,
  round(CASE WHEN max(value) OVER (PARTITION BY match_id) > 1.5 THEN value / 100 ELSE value END, 6) AS value FROM ({TRACKING_SQL})"""


def _mirror_fixed(spark, sf):
    t = metres(tracking(spark, sf))
    return t.select("frame", F.round(mirror_fixed("ball_x_m", "period", 102.0), 6).alias("xn"),
                    F.round(mirror_fixed("ball_y_m", "period", 64.0), 6).alias("yn"))


QUERIES["mirror_fixed"] = _mirror_fixed
SQL["mirror_fixed"] = f"""SELECT frame, round(CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END, 6) AS xn,
  round(CASE WHEN period = 0 THEN ball_y_m ELSE 64 - ball_y_m END, 6) AS yn FROM ({METRES_SQL})"""

SIDE = "CASE WHEN (frame * 7 + player_id) % 3 <= period THEN 'Left' ELSE 'right' END"


def _mirror_direction(spark, sf):
    t = metres(tracking(spark, sf)).withColumn("attack_direction", F.expr(SIDE))
    dirs = evs.attack_direction(t)
    out = evs.mirror_by_direction(t, dirs, {"xn": ("ball_x_m", 102.0), "yn": ("ball_y_m", 64.0)})
    return out.select("frame", r6("xn"), r6("yn"))


QUERIES["mirror_by_direction"] = _mirror_direction
SQL["mirror_by_direction"] = f"""
WITH t AS (SELECT *, lower({SIDE}) AS d FROM ({METRES_SQL})),
c AS (SELECT match_id, period, d, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT match_id, period, arg_min(d, (-n, d)) = 'right' AS high FROM c GROUP BY ALL)
SELECT frame, round(CASE WHEN high THEN ball_x_m ELSE 102 - ball_x_m END, 6) AS xn,
  round(CASE WHEN high THEN ball_y_m ELSE 64 - ball_y_m END, 6) AS yn FROM t JOIN m USING (match_id, period)"""


def _mirror_final(spark, sf):
    t = metres(tracking(spark, sf)).withColumn("seq_id", F.col("player_id"))
    shots = t.groupBy("match_id", "seq_id").agg(F.max((F.col("event_type") == "purchase").cast("int")
                                                      * (F.col("frame") % 11 == 0).cast("int")).alias("shot"))
    last = attack.last_ball(t).join(shots, ["match_id", "seq_id"], "left")
    return attack.direction_by_final_ball(last).withColumn("attacks_high", F.col("attacks_high").cast("int"))


QUERIES["mirror_by_final_ball"] = _mirror_final
SQL["mirror_by_final_ball"] = f"""
WITH t AS ({METRES_SQL}),
s AS (SELECT match_id, player_id, max(CASE WHEN event_type = 'purchase' AND frame % 11 = 0 THEN 1 ELSE 0 END) AS shot FROM t GROUP BY ALL),
l AS (SELECT match_id, period, player_id, arg_max(ball_x_m, (match_time, frame)) AS bx FROM t GROUP BY ALL)
SELECT match_id, period, CASE WHEN coalesce(CASE WHEN max(shot) = 1 THEN quantile_cont(bx, 0.5) FILTER (WHERE shot = 1)
  ELSE quantile_cont(bx, 0.5) END >= 51, FALSE) THEN 1 ELSE 0 END AS attacks_high
FROM l JOIN s USING (match_id, player_id) GROUP BY ALL"""


def _votes(spark, sf):
    t = metres(tracking(spark, sf)).selectExpr(
        "match_id", "period", "frame AS seq_id", "ball_x_m AS ball_x_m_end", "x_m AS ball_x_m_start",
        "CASE WHEN frame % 4 = 0 THEN ball_x_m WHEN frame % 4 = 1 THEN 51 ELSE 102 - ball_x_m END AS ball_x_norm_end",
        "CASE WHEN frame % 5 = 0 THEN NULL WHEN frame % 3 = 0 THEN x_m ELSE 102 - x_m END AS ball_x_norm_start")
    out = attack.attack_side(t)
    return out.select("match_id", "seq_id", F.col("attacks_left").cast("int").alias("attacks_left"))


QUERIES["attack_side_votes"] = _votes
SQL["attack_side_votes"] = f"""
WITH t AS (SELECT match_id, period, frame, ball_x_m AS re, x_m AS rs,
  CASE WHEN frame % 4 = 0 THEN ball_x_m WHEN frame % 4 = 1 THEN 51 ELSE 102 - ball_x_m END AS ne,
  CASE WHEN frame % 5 = 0 THEN NULL WHEN frame % 3 = 0 THEN x_m ELSE 102 - x_m END AS ns FROM ({METRES_SQL})),
v AS (SELECT *, CASE WHEN abs(abs(ne - (102 - re)) - abs(ne - re)) >= 1 THEN (abs(ne - (102 - re)) < abs(ne - re))::INT END AS ve,
  CASE WHEN abs(abs(ns - (102 - rs)) - abs(ns - rs)) >= 1 THEN (abs(ns - (102 - rs)) < abs(ns - rs))::INT END AS vs FROM t),
p AS (SELECT match_id, period, (avg(ve) >= 0.5)::INT AS side FROM v GROUP BY ALL)
SELECT v.match_id, frame AS seq_id, coalesce(CASE WHEN ve IS NOT NULL OR vs IS NOT NULL THEN
  (coalesce(ve, 0) + coalesce(vs, 0) > ((ve IS NOT NULL)::INT + (vs IS NOT NULL)::INT) / 2.0)::INT END, side) AS attacks_left
FROM v JOIN p USING (match_id, period)"""


def _reference(spark, sf):
    t = tracking(spark, sf).select("match_id", "period", "player_id", "team_id", "frame", "match_time", "event_type")
    out = align.reference_event(t.where("event_type = 'error'"), t.where("event_type = 'view'"), ["frame"], 12 * HOUR,
                                blocks(spark, sf), ordinal="frame")
    return out.select("frame", "ref_frame", F.col("ref_time").cast("long").alias("ref_time"), "ref_level")


QUERIES["reference_event"] = _reference
SQL["reference_event"] = f"""
WITH t AS ({TRACKING_SQL}),
p AS (SELECT e.frame, v.frame AS ref_frame, v.match_time AS ref_time,
  CASE WHEN v.player_id = e.player_id THEN 1 WHEN v.team_id = e.team_id THEN 2 ELSE 3 END AS ref_level,
  abs(v.match_time - e.match_time) AS d FROM t e JOIN t v ON e.match_id = v.match_id AND e.period = v.period
  AND v.event_type = 'view' AND v.match_time BETWEEN e.match_time - {12 * HOUR} AND e.match_time + {12 * HOUR}
  WHERE e.event_type = 'error'),
b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ref_level, d, ref_time, ref_frame) AS rn FROM p)
SELECT t.frame, ref_frame, ref_time, ref_level FROM t LEFT JOIN b ON t.frame = b.frame AND rn = 1 WHERE event_type = 'error'"""


def _recalibrate(spark, sf):
    t = tracking(spark, sf).select("match_id", "period", "player_id", "frame", "match_time", "x", "y", "ball_x", "ball_y", "event_type")
    events = t.where("event_type = 'signup'").selectExpr(
        "match_id", "period", "player_id", "match_time", "(frame * 29 % 1000) / CAST(1000 AS DOUBLE) AS x",
        "(frame * 71 % 1000) / CAST(1000 AS DOUBLE) AS y", "CASE WHEN frame % 3 = 0 THEN 'goalkick' END AS setpiece_type")
    out = align.recalibrate_single(t, events, blocks=blocks(spark, sf))
    return out.select("frame", r6("x"), r6("y"), r6("ball_x"), r6("ball_y"))


QUERIES["recalibrate_single"] = _recalibrate
SQL["recalibrate_single"] = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY match_id, period, player_id ORDER BY match_time, frame) AS rk FROM ({TRACKING_SQL})),
e AS (SELECT match_id, period, player_id, match_time AS et, rk AS ar, least(rk - 1, 4) AS n, frame % 3 = 0 AS sp,
  (frame * 29 % 1000) / 1000.0::DOUBLE - x AS dx, (frame * 71 % 1000) / 1000.0::DOUBLE - y AS dy FROM t WHERE event_type = 'signup'),
m AS (SELECT *, k, CASE WHEN k = 0 THEN 1.0::DOUBLE WHEN k > 0 THEN [0.95, 0.85, 0.70, 0.50][k]::DOUBLE
  WHEN sp THEN [0.30, 0.50, 0.70, 0.85, 0.97][5 - n + k + n + 1]::DOUBLE
  ELSE pow((k + n + 1) / n::DOUBLE, 0.6) END AS w
  FROM e, range(-4, 5) r(k) WHERE sqrt((dx * 102)**2 + (dy * 64)**2) > 0.25 AND ar + k >= 1),
s AS (SELECT match_id, period, player_id, ar + k AS rk, sum(w * dx) AS sx, sum(w * dy) AS sy, max(w) AS w, max(sp) AS sp,
  max(et) AS et FROM m GROUP BY ALL),
o AS (SELECT t.*, t.x + coalesce(sx, 0) AS nx, t.y + coalesce(sy, 0) AS ny, CASE WHEN sp THEN CASE WHEN w = 1 THEN 0.98 END
  WHEN w = 1 THEN 0.90 WHEN match_time < et THEN 0.35 WHEN w IS NOT NULL THEN 0.20 END AS b FROM t LEFT JOIN s USING (match_id, period, player_id, rk))
SELECT frame, round(greatest(least(nx, 1), 0), 6) AS x, round(greatest(least(ny, 1), 0), 6) AS y,
  round(greatest(least(CASE WHEN b IS NULL THEN ball_x ELSE (1 - b) * ball_x + b * nx END, 1), 0), 6) AS ball_x,
  round(greatest(least(CASE WHEN b IS NULL THEN ball_y ELSE (1 - b) * ball_y + b * ny END, 1), 0), 6) AS ball_y FROM o"""


def _recalibrate_sparse(spark, sf):
    """The shipped correction on one event per player and period, whose windows cannot touch."""
    t = tracking(spark, sf).select("match_id", "period", "player_id", "frame", "match_time", "x", "y", "ball_x", "ball_y", "event_type")
    first = first_rows(t.where("event_type = 'signup'"), ["match_id", "period", "player_id"], [F.col("frame")])
    events = first.selectExpr(
        "match_id", "period", "player_id", "match_time", "(frame * 29 % 1000) / CAST(1000 AS DOUBLE) AS x",
        "(frame * 71 % 1000) / CAST(1000 AS DOUBLE) AS y", "CASE WHEN frame % 3 = 0 THEN 'goalkick' END AS setpiece_type", "frame AS event_no")
    out = align.apply_recalibration(t, events, blocks=blocks(spark, sf))
    return out.select("frame", r6("x"), r6("y"), r6("ball_x"), r6("ball_y"))


QUERIES["recalibrate_sparse"] = _recalibrate_sparse
SQL["recalibrate_sparse"] = SQL["recalibrate_single"].replace("WHERE event_type = 'signup'),", """WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY match_id, period, player_id ORDER BY frame) = 1),""")


def _candidates(spark, sf):
    t = tracking(spark, sf).select("match_id", "period", "player_id", "frame", "match_time", "x", "y", "ball_x", "ball_y", "event_type")
    ev = t.where("event_type = 'error'").select("match_id", "period", "player_id", "match_time", F.col("frame").alias("event_id"), "x", "y")
    rules = align.AlignRules(tolerance_ms=6 * HOUR, error_m=30.0, ball_m=20.0)
    hit = align.candidates(align.match_events(ev, t.where("event_type = 'view'"), rules, blocks(spark, sf)), rules)
    return hit.select("event_id", "track_frame", r6("error_m"), r6("player_ball_m"))


QUERIES["recalibration_candidates"] = _candidates
SQL["recalibration_candidates"] = f"""
WITH t AS ({TRACKING_SQL}),
p AS (SELECT l.frame AS event_id, r.frame AS track_frame, sqrt(((l.x - r.x) * 102)**2 + ((l.y - r.y) * 64)**2) AS error_m,
  sqrt(((r.x - r.ball_x) * 102)**2 + ((r.y - r.ball_y) * 64)**2) AS player_ball_m,
  row_number() OVER (PARTITION BY l.frame ORDER BY abs(r.match_time - l.match_time), r.match_time, r.frame) AS rn
  FROM t l JOIN t r ON l.player_id = r.player_id AND l.period = r.period AND l.match_id = r.match_id
   AND abs(r.match_time - l.match_time) <= {6 * HOUR} WHERE l.event_type = 'error' AND r.event_type = 'view')
SELECT event_id, track_frame, round(error_m, 6) AS error_m, round(player_ball_m, 6) AS player_ball_m FROM p
WHERE rn = 1 AND error_m > 30 AND player_ball_m > 20"""
