"""Feeds in their landed form, sinks, versions, model store, detail table and the recalibration of all events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..lineage import checkpoint_folder
from ..operators import align, attack, cluster as cl, detail as dt, tracking as tr
from ..plans import season as plan
from ..sources import catalogue as cat, readers as rd, writers as wr
from .adapter import HOUR, ORDERS_SQL, TRACKING_SQL, blocks, r6, sequences_of_orders, split_columns, table, tracking

QUERIES, SQL = {}, {}


def put(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def new_folder(spark) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/out-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------------ feeds

def _flatten(spark, sf):
    """An hour of a match is a frame: its events are the players, the first one has the ball."""
    t = tracking(spark, sf)
    player = F.struct("frame", "player_id", "x", "y")
    first = F.min_by(F.struct(F.col("ball_x").alias("x"), F.col("ball_y").alias("y")), "frame")
    frames = t.groupBy("match_id", F.col("period").alias("period_order"), F.floor(F.col("match_time") / HOUR).alias("frame_index")).agg(
        F.min("match_time").alias("match_time"), F.when(F.count("*") > 1, F.array(first)).otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("balls"),
        F.transform(F.sort_array(F.collect_list(player)), lambda p: F.struct(p["player_id"].alias("player_id"), p["x"].alias("x"), p["y"].alias("y"))).alias("players"))
    lineup = t.where("player_id % 3 > 0").select("match_id", "player_id", F.concat(F.lit("P"), "player_id").alias("player_name"), "team_id").distinct()
    rows = tr.flatten_frames(frames.withColumn("ball_state", F.lit("alive")), lineup)
    return rows.select("match_id", "period", "frame", "match_time", "player_pos", "player_id", "player_name", "team_id", "x", "y", "ball_x", "ball_y", r6("dist_ball"))


put("flatten_frames", _flatten, f"""
WITH t AS (SELECT *, match_time // {HOUR} AS hr, CASE WHEN player_id % 3 > 0 THEN team_id END AS team FROM ({TRACKING_SQL})),
b AS (SELECT *, count(*) OVER w > 1 AS live, row_number() OVER (w ORDER BY frame) - 1 AS pos, min(match_time) OVER w AS mt,
  first(ball_x) OVER (w ORDER BY frame) AS bx, first(ball_y) OVER (w ORDER BY frame) AS yb FROM t WINDOW w AS (PARTITION BY match_id, period, hr))
SELECT match_id, period, hr AS frame, mt AS match_time, pos::INT AS player_pos, player_id, CASE WHEN player_id % 3 > 0 THEN 'P' || player_id ELSE 'ID: ' || player_id END AS player_name,
  team AS team_id, x, y, CASE WHEN live THEN bx END AS ball_x, CASE WHEN live THEN yb END AS ball_y, round(CASE WHEN live THEN sqrt((x - bx)**2 + (y - yb)**2) END, 6) AS dist_ball FROM b""")


def _match_list(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    new = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("match_date"), F.struct(F.col("c_name").alias("name")).alias("home_team"),
                             F.col("n_name").alias("away_team_name")))
    old = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("match_id"), F.lit("").alias("match_date"), F.col("n_name").alias("start_time"),
                             F.lit("").alias("home_team_name"), F.struct(F.lit("").alias("name"), F.col("c_name").alias("team_name")).alias("away_team")))
    raw = c.select(F.when(F.col("c_custkey") % 7 == 0, F.lit('{"date": "2025-01-01"}')).when(F.col("c_custkey") % 2 == 0, new).otherwise(old).alias("raw"))
    return cat.normalise_matches(raw).drop("raw")


put("match_list", _match_list, """
SELECT c_custkey AS match_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE n_name END AS match_date, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS home_team,
  CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS away_team FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0""")


def _lineup(spark, sf):
    c = table(spark, sf, "customer")
    full = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit(""))
    player = F.struct(F.col("c_custkey").cast("string").alias("player_id"), full.alias("player_full_name"),
                      F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("player_name"), F.col("c_nationkey").cast("long").alias("team_id"),
                      F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("team_full_name"), F.lit("short").alias("team_name"))
    raw = c.groupBy(F.col("c_nationkey").alias("match_id")).agg(F.collect_list(player).alias("lineup"))
    raw = raw.select("match_id", F.to_json(F.struct(F.array(F.struct("lineup")).alias("data"))).alias("raw"))
    return cat.lineup_dim(raw)


put("lineup", _lineup, """
SELECT c_nationkey AS match_id, c_custkey AS player_id, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS player_name,
  c_nationkey::BIGINT AS team_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'short' END AS team_name FROM customer""")


def _provider(spark, sf):
    """Two header styles of the provider's sequences: milliseconds with ends, seconds with durations."""
    o = sequences_of_orders(spark, sf)
    ms = o.where("seq_id % 2 = 0").selectExpr(
        "match_id", "CAST(seq_id AS STRING) AS sequenceId", "CAST(customer_id % 5 AS STRING) AS teamId", "'1' AS periodOrder", "CAST(seq_id * 10 AS STRING) AS startTimeMs",
        "CAST(seq_id * 10 + 500 AS STRING) AS endTimeMs", "concat('[', seq_id, ', ', customer_id, ']') AS eventIds", "CAST(passes AS STRING) AS numOfPasses", "'FORWARD' AS progressDirection")
    sec = o.where("seq_id % 2 = 1").selectExpr(
        "match_id", "CASE WHEN seq_id % 5 = 0 THEN 'none' ELSE CAST(customer_id % 5 AS STRING) END AS possession_team_id", "CAST(seq_id % 2 AS STRING) AS period",
        "CAST(seq_id AS STRING) AS start_sec", "CAST(duration_s AS STRING) AS duration_sec", "CAST(seq_id AS STRING) AS start_time")
    both = rd.union_all([rd.coalesce_schema(ms), rd.coalesce_schema(sec)])
    return both.select("match_id", "provider_id", "team_id", "period", r6("start_ms"), r6("end_ms"), F.size("event_ids").alias("n_events"),
                       F.try_element_at("event_ids", F.lit(1)).alias("first_event"), r6("num_passes"),
                       "progress_direction", "ball_status")


put("coalesce_schema", _provider, f"""
WITH o AS ({ORDERS_SQL})
SELECT match_id, CASE WHEN seq_id % 2 = 0 THEN seq_id::VARCHAR ELSE (seq_id % 2) || '-' || seq_id END AS provider_id, customer_id % 5 AS team_id, 1::BIGINT AS period,
  CASE WHEN seq_id % 2 = 0 THEN seq_id * 10 ELSE seq_id END::DOUBLE AS start_ms, CASE WHEN seq_id % 2 = 0 THEN seq_id * 10 + 500 ELSE seq_id + duration_s * 1000 END::DOUBLE AS end_ms,
  CASE WHEN seq_id % 2 = 0 THEN 2 ELSE 0 END AS n_events, CASE WHEN seq_id % 2 = 0 THEN seq_id::VARCHAR END AS first_event,
  CASE WHEN seq_id % 2 = 0 THEN passes END::DOUBLE AS num_passes, CASE WHEN seq_id % 2 = 0 THEN 'forward' ELSE '' END AS progress_direction, '' AS ball_status
FROM o WHERE seq_id % 2 = 0 OR seq_id % 5 <> 0""")


# ------------------------------------------------------------------------------------ sinks

def _nested(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 7).alias("ids"),
                                            F.struct(F.col("c_mktsegment").alias("segment")).alias("about"), F.concat(F.lit('say "'), "c_name", F.lit('", ok')).alias("quoted"))
    folder = new_folder(spark)
    wr.write_nested_csv(c, folder)
    back = spark.read.option("header", True).option("escape", '"').csv(folder)
    back = back.toDF(*[n.lstrip("﻿") for n in back.columns])
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "ids", "about", "quoted")


put("nested_csv", _nested, """SELECT c_custkey, '[' || c_nationkey || ',' || (c_custkey % 7) || ']' AS ids, '{"segment":"' || c_mktsegment || '"}' AS about,
  'say "' || c_name || '", ok' AS quoted FROM customer""")


def _versions(spark, sf):
    """Two published runs: all matches, then one of them again with half its sequences and none in the second table."""
    o = sequences_of_orders(spark, sf).select("match_id", "seq_id", "idd")
    folder = new_folder(spark)
    wr.publish({"detail": o, "ranking": o.where("seq_id % 3 = 0")}, folder, o)
    urgent = o.where("match_id = '1-URGENT'")
    wr.publish({"detail": urgent.where("seq_id % 2 = 0").withColumn("idd", -F.col("idd")), "ranking": urgent.where("false")}, folder, urgent)
    both = [wr.read_output(spark, folder, name).withColumn("name", F.lit(name)) for name in ("detail", "ranking")]
    return both[0].unionByName(both[1]).select("name", "match_id", "seq_id", F.round("idd", 9).alias("idd"))


put("published_versions", _versions, f"""
WITH o AS (SELECT match_id, seq_id, idd, match_id = '1-URGENT' AS again FROM ({ORDERS_SQL}))
SELECT 'detail' AS name, match_id, seq_id, round(CASE WHEN again THEN -idd ELSE idd END, 9) AS idd FROM o WHERE NOT again OR seq_id % 2 = 0
UNION ALL SELECT 'ranking', match_id, seq_id, round(idd, 9) FROM o WHERE NOT again AND seq_id % 3 = 0""")


def _store(spark, sf):
    """The store is asked twice: for some keys, then for all; only the rest is computed, and what is stored stays."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey % 50 AS match_id", "o_custkey % 3 AS team_id", "o_totalprice AS v")
    wanted, folder = o.select("match_id", "team_id").distinct(), new_folder(spark)

    def computed(sign):
        return lambda keys: o.join(keys, wr.KEYS).groupBy(*wr.KEYS).agg(F.sum(F.col("v") * sign).alias("v"))

    wr.match_result_store(spark, folder, "totals", wanted.where("match_id < 20"), computed(-1))
    return wr.match_result_store(spark, folder, "totals", wanted, computed(1)).select(
        F.col("match_id").cast("long").alias("match_id"), F.col("team_id").cast("long").alias("team_id"), F.round("v", 2).alias("v"))


put("result_store", _store, """SELECT o_orderkey % 50 AS match_id, o_custkey % 3 AS team_id,
  round(sum(CASE WHEN o_orderkey % 50 < 20 THEN -o_totalprice ELSE o_totalprice END), 2) AS v FROM orders GROUP BY ALL""")


def _outputs(spark, sf):
    meta = sequences_of_orders(spark, sf).groupBy("match_id").agg(F.max("cluster").alias("rival"), F.max("customer_id").alias("modified"), F.count("*").alias("n"))
    return wr.list_outputs(meta.withColumn("path", F.concat(F.lit("gold/"), "match_id")))


put("list_outputs", _outputs, f"""SELECT match_id, max(cluster) AS rival, 'gold/' || match_id AS path, max(customer_id) AS modified FROM ({ORDERS_SQL}) GROUP BY match_id""")


def _model_store(spark, sf):
    """A stored model gives every row the cluster that the model in memory gives it."""
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    model, _ = cl.fit_pipeline(e, 5, restarts=1)
    folder = new_folder(spark)
    cl.save_model(model, folder)
    stored = cl.load_model(folder)
    here, there = cl.apply_model(e, model), cl.apply_model(e, stored)
    both = here.select("vec_id", "cluster").join(there.select("vec_id", F.col("cluster").alias("again")), "vec_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("cluster") != F.col("again")).alias("other"), F.lit(cl.model_size(stored)).alias("size"),
                    F.lit(cl.load_model(folder + "-none") is None).alias("none"))


put("model_store", _model_store, "SELECT count(*) AS n, 0::BIGINT AS other, 5 AS size, TRUE AS none FROM embeddings WHERE embedding IS NOT NULL")


# ------------------------------------------------------------------------------------ season tables

def _index_inputs(spark, sf):
    o = sequences_of_orders(spark, sf)
    profile = o.where("seq_id % 5 < 4").select("match_id", "seq_id", F.col("idd").alias("width_mean"))
    control = o.where("seq_id % 2 = 0").select("match_id", "seq_id", F.col("ipo").alias("danger_rival_mean"))
    xt = o.where("seq_id % 3 = 0").select("match_id", "seq_id", "xt_max")
    have = {c: F.col(c) for c in ("cluster", "shot", "on_target", "goal", "x_max")}
    summary = o.where("seq_id % 7 > 0").select("match_id", "seq_id", *[have.get(c, F.lit(None).cast("double")).alias(c) for c in plan.SUMMARY])
    return plan.index_inputs(profile, control, xt, summary).select("match_id", "seq_id", *[F.round(c, 9).alias(c) for c in ("width_mean", "danger_rival_mean", "xt_max")], "cluster", "shot", "goal")


put("index_inputs", _index_inputs, f"""SELECT match_id, seq_id, round(idd, 9) AS width_mean, CASE WHEN seq_id % 2 = 0 THEN round(ipo, 9) END AS danger_rival_mean,
  CASE WHEN seq_id % 3 = 0 THEN round(xt_max, 9) END AS xt_max, CASE WHEN seq_id % 7 > 0 THEN cluster END AS cluster, CASE WHEN seq_id % 7 > 0 THEN shot END AS shot,
  CASE WHEN seq_id % 7 > 0 THEN goal END AS goal FROM ({ORDERS_SQL}) WHERE seq_id % 5 < 4""")


def _totals(model_k):
    def run(spark, sf):
        o = sequences_of_orders(spark, sf)
        teams = o.groupBy("match_id").agg(F.min("customer_id").alias("own_team"), F.max("customer_id").alias("rival_team"))
        kept = o.where("duration_s > 5 AND match_id <> '5-LOW'")
        return plan.stage_totals(o, o.where("seq_id % 4 = 0"), o.where("seq_id % 3 = 0"), o.where("duration_s > 3"), o.where("shot = 1"), kept, teams, model_k)
    return run


_TOTALS_SQL = f"""
WITH o AS (SELECT *, duration_s > 5 AND match_id <> '5-LOW' AS kept FROM ({ORDERS_SQL}))
SELECT match_id, count(*) AS tracking_raw, count(*) FILTER (seq_id % 4 = 0) AS tracking_bucketed, count(*) FILTER (seq_id % 3 = 0) AS events_raw,
  count(*) FILTER (duration_s > 3) AS sequences_detected, count(*) FILTER (kept) AS sequences, count(*) FILTER (shot = 1) AS shots_rival,
  count(*) FILTER (shot = 1 AND on_target = 1) AS shots_on_target_rival, count(*) FILTER (kept AND shot = 1) AS shots_assigned,
  count(DISTINCT CASE WHEN kept THEN cluster END) AS typologies, min(customer_id) AS own_team, max(customer_id) AS rival_team, {{}} FROM o GROUP BY match_id"""
put("stage_totals", _totals(None), _TOTALS_SQL.format("'partido_auto' AS cluster_scope, count(DISTINCT CASE WHEN kept THEN cluster END) AS n_clusters_model"))
put("stage_totals_stored_model", _totals(4), _TOTALS_SQL.format("'global' AS cluster_scope, 4::BIGINT AS n_clusters_model"))


def _minimap(spark, sf):
    """Customers' orders as paths: up to 24 points in the order of their keys."""
    o = sequences_of_orders(spark, sf).selectExpr("customer_id % 4 AS match_id", "customer_id AS seq_id", "seq_id AS k", "customer_id % 2 AS period", "x_max * 1.1 - 3 AS ball_x_m",
                                                  "y_end * 1.1 - 2 AS ball_y_m", "seq_id * 40 AS match_time")
    points = tr.first_rows(o, ["match_id", "seq_id"], [F.col("k")], 24).withColumnRenamed("k", "point_order")
    sides = points.select("match_id", "seq_id", (F.col("seq_id") % 3 == 0).alias("attacks_left")).distinct()
    index = spark.createDataFrame([(0, 0, 5000.0, 1000.0), (1, 1, 0.0, 2000.0)], "match_id long, period long, padding_ms double, start_ms double")
    out = attack.minimap_points(points, sides, index)
    p = out.select("match_id", "seq_id", "attacks_left", F.size("points").alias("n"), F.posexplode("points").alias("i", "p"))
    return p.select("match_id", "seq_id", "attacks_left", "n", "i", "p.point_order", *[F.round(f"p.{c}", 2).alias(c) for c in ("video_s", "match_s")],
                    F.round(F.col("p.x"), 1).alias("x"), F.round(F.col("p.y"), 1).alias("y"))


put("minimap_points", _minimap, f"""
WITH o AS (SELECT customer_id % 4 AS match_id, customer_id AS seq_id, seq_id AS k, customer_id % 2 AS period, greatest(least(x_max * 1.1::DOUBLE - 3, 102), 0) AS x,
    greatest(least(y_end * 1.1::DOUBLE - 2, 64), 0) AS y, seq_id * 40 AS mt, row_number() OVER (PARTITION BY customer_id ORDER BY seq_id) - 1 AS i FROM ({ORDERS_SQL})),
c AS (SELECT *, count(*) OVER (PARTITION BY seq_id)::INT AS n FROM o WHERE i < 24)
SELECT match_id, seq_id, seq_id % 3 = 0 AS attacks_left, n, i::INT AS i, k AS point_order, round(CASE WHEN match_id = 0 AND period = 0 THEN greatest((mt - 1000 + 5000) / 1000.0, 0)
    WHEN match_id = 1 AND period = 1 THEN greatest((mt - 2000) / 1000.0, 0) ELSE mt / 1000.0 END::DOUBLE, 2) AS video_s, round(mt / 1000.0::DOUBLE, 2) AS match_s,
  round(x, 1) AS x, round(y, 1) AS y FROM c WHERE n >= 2""")


_DETAIL_INPUT = """match_id, seq_id, CAST(seq_id % 5 AS INT) AS cluster, (seq_id * 37 % 997) / CAST(997 AS DOUBLE) AS idd, (seq_id * 53 % 991) / CAST(991 AS DOUBLE) AS ipo,
  (seq_id * 29 % 983) / CAST(3000 AS DOUBLE) AS xt_max, (seq_id * 31 % 977) / CAST(977 AS DOUBLE) AS danger_rival_mean"""
_SPAN_INPUT = "seq_id % 2 AS period, seq_id * 31 % 500 * 6000 + 1000 AS start_ms, seq_id * 31 % 500 * 6000 + 1000 + seq_id % 4 * 6000 AS end_ms"


def _detail(spark, sf):
    o = sequences_of_orders(spark, sf)
    indexed = o.selectExpr(*split_columns(_DETAIL_INPUT))
    seqs = o.selectExpr("match_id", "seq_id", *split_columns(_SPAN_INPUT))
    checked = o.where("seq_id % 3 > 0").selectExpr("match_id", "seq_id", "seq_id % 3 = 1 AS rival_ok")
    out = dt.sequence_detail(indexed, seqs, checked)
    return out.select("match_id", "seq_id", "typology", "cluster", "period", "minute", "start_s", "end_s", "idd", "ipo", "score", "xt_max", "xt_peak", r6("danger_behind"))


put("sequence_detail", _detail, f"""
WITH o AS (SELECT {_DETAIL_INPUT}, {_SPAN_INPUT} FROM ({ORDERS_SQL})),
m AS (SELECT *, min(CASE WHEN period = 1 THEN end_ms / 60000.0::DOUBLE END) OVER (PARTITION BY match_id) AS low FROM o)
SELECT match_id, seq_id, 'T' || cluster AS typology, cluster, period, round(end_ms / 60000.0::DOUBLE + CASE WHEN period = 1 AND low < 40 THEN 45 ELSE 0 END, 1) AS minute,
  start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, round(idd, 3) AS idd, round(ipo, 3) AS ipo,
  round(0.45::DOUBLE * ipo + 0.35::DOUBLE * idd + 0.20::DOUBLE * xt_max, 3) AS score, round(xt_max, 3) AS xt_max, round(xt_max, 3) AS xt_peak,
  round(danger_rival_mean, 6) AS danger_behind FROM m""")


def _types(spark, sf):
    """A detail table read as text, and the ranking rows of a match that has none."""
    o = sequences_of_orders(spark, sf)
    text = o.where("match_id <> '5-LOW'").selectExpr(
        "match_id", "seq_id", "CAST(seq_id % 5 AS STRING) AS cluster", "CASE WHEN seq_id % 11 = 0 THEN 'bad' ELSE CAST(idd AS STRING) END AS idd", "CAST(minute AS STRING) AS minute",
        "CASE seq_id % 4 WHEN 0 THEN 'Sí' WHEN 1 THEN 'YES' WHEN 2 THEN '0' END AS goal", "CASE WHEN seq_id % 2 = 0 THEN 'Contraataque' END AS typology")
    other = o.selectExpr("match_id", "seq_id", "CAST(seq_id % 5 AS STRING) AS cluster", "CAST(-idd AS STRING) AS idd")
    return dt.detail_types(text, other).select("match_id", "seq_id", F.round("idd", 9).alias("idd"), r6("minute"), "goal", "typology")


put("detail_types", _types, f"""
SELECT match_id, seq_id, round(CASE WHEN match_id = '5-LOW' THEN -idd WHEN seq_id % 11 > 0 THEN idd END, 9) AS idd, CASE WHEN match_id <> '5-LOW' THEN round(minute, 6) END AS minute,
  CASE WHEN match_id <> '5-LOW' AND seq_id % 4 < 2 THEN 1 ELSE 0 END AS goal, CASE WHEN match_id <> '5-LOW' AND seq_id % 2 = 0 THEN 'Contraataque' ELSE 'Tipología ' || (seq_id % 5 + 1) END AS typology
FROM ({ORDERS_SQL})""")


# ------------------------------------------------------------------------------------ recalibration of all events

ALL_EVENTS = """match_id, period, player_id, CAST(match_time AS DOUBLE) AS match_time, (frame * 29 % 1000) / CAST(1000 AS DOUBLE) AS x, (frame * 71 % 1000) / CAST(1000 AS DOUBLE) AS y,
  CASE WHEN frame % 5 = 0 THEN 'throwin' WHEN frame % 3 = 0 THEN 'goalkick' END AS setpiece_type, frame AS event_no"""


def dense_inputs(spark, sf):
    """The tracking and every signup as an event: most windows touch others of the same player."""
    t = tracking(spark, sf).select("match_id", "period", "player_id", "frame", "match_time", "x", "y", "ball_x", "ball_y", "event_type")
    return t.drop("event_type"), t.where("event_type = 'signup'").selectExpr(*split_columns(ALL_EVENTS))


def lost_ball(t):
    """The tracking without a ball in runs of frames."""
    return t.withColumns({c: F.when(F.col("frame") % 11 >= 5, F.col(c)) for c in ("ball_x", "ball_y")})


def _dense(spark, sf):
    t, events = dense_inputs(spark, sf)
    out, log = align.apply_with_log(t, events, blocks=blocks(spark, sf))
    told = log.select("match_id", "period", F.col("event_no").alias("frame"), "mode", r6("dx"), r6("dy"))
    return out.join(told, ["match_id", "period", "frame"], "left").select("match_id", "period", "frame", r6("x"), r6("y"), r6("ball_x"), r6("ball_y"), "mode", "dx", "dy")


put("recalibrate_dense", _dense)


def _outs(spark, sf):
    t, events = dense_inputs(spark, sf)
    t = lost_ball(t)
    starts = t.groupBy("match_id", "period", "player_id").agg(F.min("match_time").alias("first_ms"))
    throws = events.where("setpiece_type = 'throwin'").join(starts, ["match_id", "period", "player_id"])
    rules = align.AlignRules(throw_back_ms=HOUR, throw_min_ms=HOUR // 2)
    return align.ball_outs(t.select("match_id", "period", "frame", "match_time", "ball_x", "ball_y"), throws, rules, blocks(spark, sf)).select(
        "match_id", "period", "event_no", "out_ms")


put("throw_in_outs", _outs)


def _diagnostics(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("embedding")
    diag = cl.elbow_strength(cl.kmeans_diagnostics(e, "embedding", 64, 2, 5, restarts=3))
    return diag.select("k", r6("inertia"), r6("silhouette"), "min_cluster_size", r6("elbow_strength"))


put("kmeans_diagnostics", _diagnostics)
