"""JSON fields, labels, clocks, text repair and name handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr, jsontext as jt, labels as lb
from ..operators import events as evs, intervals as iv, timeline as tl
from ..sources import catalogue as cat
from ..sources.textrepair import repair_columns
from .adapter import DAY, ORDERS_SQL, TRACKING_SQL, blocks, r6, sequences_of_orders, split_columns, table, tracking

QUERIES, SQL = {}, {}

# an event feed in its JSON form, derived from the stream
FEED = """event_id AS id, user_id % 3 AS match_id, user_id % 2 AS team_id, concat('[{"event_type":"',
  CASE event_type WHEN 'purchase' THEN 'Shot' WHEN 'signup' THEN 'SetPiece' WHEN 'error' THEN 'ownGoal' ELSE event_type END,
  '","property":{"outcome":"', CASE event_id % 7 WHEN 0 THEN 'Goal' WHEN 1 THEN 'saved' WHEN 2 THEN 'post' WHEN 3 THEN 'shotGoal' ELSE 'x' END,
  '","type":"', CASE event_id % 5 WHEN 0 THEN 'Corner' ELSE 'throwIn' END, '","', CASE event_id % 4 WHEN 0 THEN 'xG' WHEN 1 THEN 'my_expected' WHEN 2 THEN 'other' ELSE 'xg' END,
  '":"', CASE event_id % 6 WHEN 0 THEN 'none' ELSE concat('0.', event_id % 89 + 10) END, '"}}', CASE event_id % 11 WHEN 0 THEN '' ELSE ']' END) AS events"""


def _feed(spark, sf):
    return table(spark, sf, "events").selectExpr(*split_columns(FEED))


FEED_SQL = f"SELECT {FEED} FROM events"


def _json(spark, sf):
    e = evs.typed_events(_feed(spark, sf))
    prop = F.col("p")
    e = e.withColumn("p", jt.event_property("events_parsed", "shot"))
    return e.select(F.col("event_id").cast("long").alias("id"), F.col("events_parsed").isNotNull().cast("int").alias("readable"),
                    F.try_element_at("event_types", F.lit(1)).alias("kind"), "setpiece_type", jt.shot_on_target(prop).cast("int").alias("on_target"),
                    jt.is_goal(prop).cast("int").alias("goal"), r6(jt.shot_xg(prop), "xg"))


QUERIES["json_fields"] = _json
_J = f"""j AS (SELECT id, match_id, team_id, CASE WHEN json_valid(events) THEN events END AS e FROM ({FEED_SQL})),
k AS (SELECT *, lower(e->0->>'event_type') AS kind, e->0->'property' AS p FROM j)"""
SQL["json_fields"] = f"""
WITH {_J},
s AS (SELECT *, CASE WHEN kind = 'shot' THEN lower(concat_ws(' ', p->>'outcome', p->>'type', p->>'xG', p->>'xg', p->>'my_expected', p->>'other')) ELSE '' END AS txt FROM k)
SELECT id, (e IS NOT NULL)::INT AS readable, kind, CASE WHEN kind = 'setpiece' THEN lower(p->>'type') END AS setpiece_type,
  (txt NOT LIKE '%post%' AND (txt LIKE '%goal%' OR txt LIKE '%save%'))::INT AS on_target, (txt LIKE '%gol%' OR txt LIKE '%goal%')::INT AS goal,
  round(CASE WHEN kind = 'shot' THEN TRY_CAST(coalesce(p->>'xg', p->>'xG', p->>'my_expected') AS DOUBLE) END, 6) AS xg FROM s"""


def _shots(spark, sf):
    feed = table(spark, sf, "events").selectExpr(*split_columns(SHOTS))
    teams = feed.select("match_id").distinct().selectExpr("match_id", "CAST(0 AS BIGINT) AS own_team", "CAST(1 AS BIGINT) AS rival_team")
    out = evs.official_shots(feed, teams, blocks(spark, sf), window_ms=600_000)
    return out.select(F.col("event_id").cast("long").alias("id"), "match_id", "on_target", F.col("goal").cast("int").alias("goal"), r6("xg"))


# the same feed with clock, period and saves
SHOTS = FEED.replace("{", "{{").replace("}", "}}").replace("WHEN 'error' THEN 'ownGoal'", "WHEN 'view' THEN 'Save'").replace("WHEN 0 THEN '' ELSE ']' END", "WHEN -1 THEN '' ELSE ']' END") + """,
  CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS period_order, {ms} AS event_time"""
SHOTS_SQL = SHOTS.format(ms="date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 1000")
SHOTS = SHOTS.format(ms="timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").replace("< TIMESTAMP '", "< TIMESTAMP_NTZ '")
QUERIES["official_shots"] = _shots
SQL["official_shots"] = f"""
WITH j AS (SELECT id, match_id, team_id, period_order AS pe, event_time AS t, lower(events->0->>'event_type') AS kind, events->0->'property' AS p FROM (SELECT {SHOTS_SQL} FROM events)),
s AS (SELECT *, lower(concat_ws(' ', p->>'outcome', p->>'type', p->>'xG', p->>'xg', p->>'my_expected', p->>'other')) AS txt FROM j WHERE kind = 'shot' AND team_id = 1)
SELECT id, match_id, (txt NOT LIKE '%post%' AND (txt LIKE '%goal%' OR txt LIKE '%save%') OR EXISTS (SELECT 1 FROM j v WHERE v.kind = 'save'
    AND v.match_id = s.match_id AND v.pe = s.pe AND abs(v.t - s.t) <= 600000))::INT AS on_target, (txt LIKE '%gol%' OR txt LIKE '%goal%')::INT AS goal,
  round(TRY_CAST(coalesce(p->>'xg', p->>'xG', p->>'my_expected') AS DOUBLE), 6) AS xg FROM s"""


def _score(spark, sf):
    feed = _feed(spark, sf)
    sides = feed.select("match_id").distinct().selectExpr("match_id", "CAST(0 AS BIGINT) AS home_team", "CAST(1 AS BIGINT) AS away_team")
    return evs.infer_score(feed, sides).select("match_id", "home_goals", "away_goals", "score")


QUERIES["event_score"] = _score
SQL["event_score"] = f"""
WITH {_J},
g AS (SELECT match_id, CASE WHEN kind = 'shot' AND lower(p->>'outcome') IN ('goal', 'shotgoal') THEN team_id WHEN kind = 'owngoal' THEN 1 - team_id END AS s FROM k)
SELECT match_id, count(*) FILTER (WHERE s = 0) AS home_goals, count(*) FILTER (WHERE s = 1) AS away_goals,
  concat(count(*) FILTER (WHERE s = 0), ' - ', count(*) FILTER (WHERE s = 1)) AS score FROM g GROUP BY 1"""


def _hms(spark, sf):
    return table(spark, sf, "events").select("event_id", expr.hms(F.col("value") * 97).alias("clock"))


QUERIES["hms"] = _hms
SQL["hms"] = """WITH s AS (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS s FROM events)
SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM s"""

CLOCK = "period, match_id, frame AS seq_id, match_time / CAST(60000 AS DOUBLE) AS end_s"


def _minute(spark, sf):
    t = tracking(spark, sf).selectExpr(*CLOCK.split(", "))
    t = t.withColumn("end_s", F.when(F.col("match_id") == 1, F.col("end_s") - 21600).otherwise(F.col("end_s")))
    return tl.match_minute(t, decimals=1).select("seq_id", "minute")


QUERIES["match_minute"] = _minute
SQL["match_minute"] = f"""
WITH t AS (SELECT match_id, period, frame AS seq_id, (match_time / 60000.0::DOUBLE - CASE WHEN match_id = 1 THEN 21600 ELSE 0 END) / 60 AS m FROM ({TRACKING_SQL}))
SELECT seq_id, round(CASE WHEN period = 1 AND min(m) FILTER (WHERE period = 1) OVER (PARTITION BY match_id) < 40 THEN m + 45 ELSE m END, 1) AS minute FROM t"""


def _video(spark, sf):
    index = table(spark, sf, "supplier").selectExpr("s_suppkey AS match_id", "CAST(s_nationkey % 2 AS INT) AS period",
                                                    "CAST(s_suppkey * 977 AS DOUBLE) AS padding_ms", "s_acctbal * 100 AS start_ms")
    t = tracking(spark, sf).selectExpr("player_id AS match_id", "CAST(period AS INT) AS period", "frame AS seq_id", "match_time / CAST(1000000 AS DOUBLE) AS start_s",
                                       "match_time / CAST(1000000 AS DOUBLE) + frame % 20 - 4 AS end_s")
    out = tl.clip_bounds(t, index)
    return out.select("seq_id", *[r6(c) for c in ("match_from", "match_to", "video_from", "video_to")])


QUERIES["video_time"] = _video
SQL["video_time"] = f"""
WITH t AS (SELECT player_id, period, frame, match_time / 1000000.0::DOUBLE AS s, match_time / 1000000.0::DOUBLE + frame % 20 - 4 AS e FROM ({TRACKING_SQL})),
b AS (SELECT *, greatest(s - 2, 0) AS mf, CASE WHEN e <= s THEN s + 8 ELSE e END + 2 AS mt FROM t),
v AS (SELECT b.*, CASE WHEN s_suppkey IS NULL THEN mf ELSE greatest((mf * 1000 - s_acctbal * 100 + s_suppkey * 977) / 1000, 0) END AS vf,
  CASE WHEN s_suppkey IS NULL THEN mt ELSE greatest((mt * 1000 - s_acctbal * 100 + s_suppkey * 977) / 1000, 0) END AS vt
  FROM b LEFT JOIN supplier ON s_suppkey = player_id AND s_nationkey % 2 = period)
SELECT frame AS seq_id, round(mf, 6) AS match_from, round(mt, 6) AS match_to, round(vf, 6) AS video_from,
  round(CASE WHEN vt <= vf THEN vf + greatest(mt - mf, 8) ELSE vt END, 6) AS video_to FROM v"""


def _labels(spark, sf):
    o = sequences_of_orders(spark, sf)
    codes = o.select("seq_id", F.concat(F.lit("carril_"), (F.col("seq_id") % 7).cast("string")).alias("lane"),
                     F.concat(F.lit("zona_"), (F.col("seq_id") % 6).cast("string")).alias("zone"), "cause",
                     F.when(F.col("seq_id") % 5 > 0, F.col("seq_id") % 5).alias("cluster"), "idd", "ipo")
    return codes.select("seq_id", lb.lane_label("lane").alias("lane"), lb.zone_label("zone").alias("zone"), lb.zone_short_label("zone").alias("zone_short"),
                        lb.cause_label("cause").alias("cause"), lb.typology_label("cluster").alias("typology"), lb.quadrant("idd", "ipo").alias("reading"),
                        lb.risk_level("idd").alias("risk"))


QUERIES["labels"] = _labels
SQL["labels"] = f"""
WITH o AS ({ORDERS_SQL})
SELECT seq_id, CASE seq_id % 7 WHEN 1 THEN 'Banda izquierda' WHEN 2 THEN 'Half-space izquierdo' WHEN 3 THEN 'Carril central' WHEN 4 THEN 'Half-space derecho'
   WHEN 5 THEN 'Banda derecha' ELSE 'Carril ' || (seq_id % 7) END AS lane,
  CASE seq_id % 6 WHEN 1 THEN 'Zona 1 - Inicio de campo propio' WHEN 2 THEN 'Zona 2 - Zona media' WHEN 3 THEN 'Zona 3 - Ultimo tercio'
   WHEN 4 THEN 'Zona 4 - Zona de remate' ELSE 'Zona ' || (seq_id % 6) END AS zone, 'Zona ' || (seq_id % 6) AS zone_short,
  CASE cause WHEN 'estructura_retroceso' THEN 'problemas de repliegue' WHEN 'estructura_anchura' THEN 'bloque demasiado abierto'
   WHEN 'pitch_control_rival' THEN 'dominio rival en zonas peligrosas' ELSE 'poca presión sobre poseedor' END AS cause,
  CASE WHEN seq_id % 5 > 0 THEN 'Tipología ' || (seq_id % 5 + 1) ELSE '-' END AS typology,
  CASE WHEN idd >= 0.66 AND ipo >= 0.66 THEN 'prioridad defensiva alta' WHEN ipo >= 0.66 THEN 'peligro eficiente' WHEN idd >= 0.66 THEN 'ruptura sin castigo'
   ELSE 'secuencia controlada' END AS reading, CASE WHEN idd >= 0.66 THEN 'alto' WHEN idd >= 0.33 THEN 'medio' ELSE 'bajo' END AS risk FROM o"""


def _repair(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    # mis-read the UTF-8 bytes as Latin-1, character by character, inside the JVM
    broken = d.withColumn("text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    return repair_columns(broken, ["text"]).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


QUERIES["repair_text"] = _repair
SQL["repair_text"] = "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, replace(replace(text, chr(194), ''), chr(65533), '') AS t FROM documents)"


def _pseudonymise(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team_id")).join(n, "team_id")
    order = table(spark, sf, "region").select((F.col("r_regionkey") * 3).alias("team_id"), (F.col("r_regionkey") + 1).alias("place"))
    return cat.pseudonymise_teams(s, order, own_team=7, own_label="Mi equipo", prefix="Rival").select("s_suppkey", "team_label")


QUERIES["pseudonymise"] = _pseudonymise
SQL["pseudonymise"] = """SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN 'Mi equipo' ELSE 'Rival ' || coalesce(r_regionkey + 1, 6) END AS team_label
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON s_nationkey = r_regionkey * 3"""


def _interp(spark, sf):
    t = tracking(spark, sf)
    daily = t.groupBy("match_id", F.floor(F.col("match_time") / DAY).alias("axis")).agg(F.sum("value").alias("v"))
    pts = t.select("match_id", "frame", (F.col("match_time") / F.lit(float(DAY)) * 1.1 - 1).alias("pos"))
    return iv.interpolate_lookup(pts, daily, ["match_id"], "pos", "axis", "v", "at").select("frame", F.round("at", 4).alias("at"))


QUERIES["interp_lookup"] = _interp
SQL["interp_lookup"] = f"""
WITH t AS ({TRACKING_SQL}), d AS (SELECT match_id, match_time // {DAY} AS ax, sum(value) AS v FROM t GROUP BY ALL),
e AS (SELECT match_id, min(ax) AS lo, max(ax) AS hi FROM d GROUP BY 1),
p AS (SELECT frame, t.match_id, least(greatest(match_time / {DAY}.0::DOUBLE * 1.1::DOUBLE - 1, lo), hi) AS p FROM t JOIN e ON t.match_id = e.match_id)
SELECT frame, round(CASE WHEN p = floor(p) THEN a.v ELSE a.v + (b.v - a.v) * (p - floor(p)) END, 4) AS at FROM p
JOIN d a ON a.match_id = p.match_id AND a.ax = floor(p) LEFT JOIN d b ON b.match_id = p.match_id AND b.ax = floor(p) + 1"""
