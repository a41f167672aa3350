"""Segmentation: possession runs, chains, closing events, decision tables, sequence facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsontext import id_list
from ..operators import attack, segment as sg, threat, trajectory as tj
from ..operators.ordered import Blocks
from .adapter import DAY, HOUR, INTERVALS_SQL, METRES_SQL, TRACKING_SQL, blocks, intervals, metres, r6, split_columns, table, tracking

QUERIES, SQL = {}, {}

RULES = sg.SegmentRules(transit_ms=6 * HOUR, max_gap_ms=2 * HOUR, terminal_ms=4 * HOUR, terminal_buffer_ms=60_000,
                        chain_gap_ms=5 * DAY, chain_reach_ms=15 * DAY, bucket_ms=HOUR, kick_m=20.0)


def _frames(spark, sf):
    return metres(tracking(spark, sf)).selectExpr(
        "*", "CASE WHEN event_type = 'click' THEN team_id END AS possessing_team", "(frame % 10) / CAST(10 AS DOUBLE) AS ball_speed",
        "CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END AS ball_x_norm",
        "CASE WHEN period = 0 THEN ball_y_m ELSE 64 - ball_y_m END AS ball_y_norm")


EXT_SQL = f"""f AS (SELECT *, CASE WHEN event_type = 'click' THEN team_id END AS pt, (frame % 10) / 10.0::DOUBLE AS bs,
  CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END AS xn FROM ({METRES_SQL})),
l AS (SELECT *, last_value(pt IGNORE NULLS) OVER w AS lt,
  last_value(CASE WHEN pt IS NOT NULL THEN match_time END IGNORE NULLS) OVER w AS ltm
  FROM f WINDOW w AS (PARTITION BY match_id, period ORDER BY match_time, frame ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CASE WHEN pt IS NOT NULL THEN pt WHEN match_time - ltm <= {6 * HOUR} AND bs >= 0.3 THEN lt END AS team_extended,
  CASE WHEN pt IS NOT NULL THEN 'poseedor_claro' WHEN match_time - ltm <= {6 * HOUR} AND bs >= 0.3 THEN 'balon_en_transito'
    ELSE 'sin_control' END AS possession_reason FROM l)"""


def _extend(spark, sf):
    out = sg.extend_possession(_frames(spark, sf), blocks(spark, sf), rules=RULES)
    return out.select("frame", "team_extended", "possession_reason")


QUERIES["extend_possession"] = _extend
SQL["extend_possession"] = f"WITH {EXT_SQL} SELECT frame, team_extended, possession_reason FROM x"

BLOCK_SQL = EXT_SQL + f""",
b AS (SELECT *, coalesce(team_extended = 1, FALSE) AS rv FROM x),
g AS (SELECT *, CASE WHEN rv IS DISTINCT FROM lag(rv) OVER w OR match_time - lag(match_time) OVER w > {2 * HOUR} THEN 1 ELSE 0 END AS nb
  FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY match_time, frame)),
n AS (SELECT *, (sum(nb) OVER (PARTITION BY match_id, period ORDER BY match_time, frame ROWS UNBOUNDED PRECEDING))::BIGINT AS block_no FROM g)"""


def _numbered(spark, sf):
    b = blocks(spark, sf)
    return sg.possession_blocks(sg.extend_possession(_frames(spark, sf), b, rules=RULES), F.col("team_extended") == 1, b, rules=RULES)


def _blocks(spark, sf):
    return _numbered(spark, sf).select("frame", "block_no", F.col("is_rival").cast("int").alias("is_rival"))


QUERIES["possession_blocks"] = _blocks
SQL["possession_blocks"] = f"WITH {BLOCK_SQL} SELECT frame, block_no, rv::INT AS is_rival FROM n"


def _metrics(spark, sf):
    out = sg.block_metrics(_numbered(spark, sf).where("is_rival"))
    return out.select("match_id", "period", "block_no", "start_frame", "end_frame", "start_ms", "end_ms", r6("path_m"), r6("gain_m"),
                      r6("x_max_norm"), r6("mean_speed"), "n_frames", r6("transit_share"))


QUERIES["block_metrics"] = _metrics
SQL["block_metrics"] = f"""WITH {BLOCK_SQL},
a AS (SELECT match_id, period, block_no, arg_min(frame, (match_time, frame)) AS start_frame, arg_max(frame, (match_time, frame)) AS end_frame,
  min(match_time) AS start_ms, max(match_time) AS end_ms, arg_min(ball_x_m, (match_time, frame)) AS x0, arg_max(ball_x_m, (match_time, frame)) AS x1,
  arg_min(ball_y_m, (match_time, frame)) AS y0, arg_max(ball_y_m, (match_time, frame)) AS y1, arg_min(xn, (match_time, frame)) AS n0,
  arg_max(xn, (match_time, frame)) AS n1, max(xn) AS xm, avg(bs) AS sp, count(*) AS n_frames,
  avg((possession_reason = 'balon_en_transito')::INT) AS ts FROM n WHERE rv GROUP BY ALL)
SELECT match_id, period, block_no, start_frame, end_frame, start_ms, end_ms, round(sqrt((x0 - x1)**2 + (y0 - y1)**2), 6) AS path_m,
  round(n1 - n0, 6) AS gain_m, round(xm, 6) AS x_max_norm, round(sp, 6) AS mean_speed, n_frames, round(ts, 6) AS transit_share FROM a"""


def _user_intervals(spark, sf):
    return intervals(spark, sf).drop("match_id", "period").withColumnRenamed("owner_id", "player_id")


def _chain(spark, sf):
    seqs = _user_intervals(spark, sf)
    out = sg.chain_before(seqs, seqs.select("player_id", "seq_id"), blocks(spark, sf), ("player_id",), "seq_id", RULES)
    return out.select("player_id", "seq_id", "chain_start", "n_added", F.coalesce(F.aggregate(
        F.col("members.seq_id"), F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0)).alias("member_sum"))


QUERIES["chain_before"] = _chain
SQL["chain_before"] = f"""
WITH RECURSIVE i AS ({INTERVALS_SQL}),
p AS (SELECT a.owner_id, a.seq_id, b.seq_id AS prev_id, b.start_ms AS prev_start,
  row_number() OVER (PARTITION BY a.owner_id, a.seq_id ORDER BY b.end_ms DESC, b.seq_id) AS rn
  FROM i a JOIN i b ON a.owner_id = b.owner_id AND b.end_ms <= a.start_ms AND a.start_ms - b.end_ms <= {5 * DAY}),
c AS (SELECT owner_id, seq_id, seq_id AS node, start_ms AS origin, start_ms AS cs FROM i
  UNION ALL SELECT c.owner_id, c.seq_id, p.prev_id, origin, prev_start FROM c JOIN p
    ON p.owner_id = c.owner_id AND p.seq_id = c.node AND rn = 1 WHERE origin - cs < {15 * DAY})
SELECT owner_id AS player_id, seq_id, min(cs) AS chain_start, count(*) - 1 AS n_added, (sum(node) - seq_id)::BIGINT AS member_sum
FROM c GROUP BY owner_id, seq_id"""


def _terminal(spark, sf):
    closers = tracking(spark, sf).where("event_type = 'error'").selectExpr(
        "match_id", "period", "match_time", "CASE WHEN team_id = 0 THEN 'cierre_recuperacion_propia' ELSE 'cierre_tiro_rival' END AS close_reason")
    out = sg.extend_to_terminal(intervals(spark, sf), closers, blocks(spark, sf), rules=RULES)
    return out.select("seq_id", "end_provider_ms", F.col("end_ms").cast("long").alias("end_ms"), "close_reason")


QUERIES["extend_to_terminal"] = _terminal
SQL["extend_to_terminal"] = f"""
WITH t AS ({TRACKING_SQL}), i AS ({INTERVALS_SQL}),
n AS (SELECT i.*, (SELECT min(j.start_ms) FROM i j WHERE j.match_id = i.match_id AND j.period = i.period AND j.start_ms > i.end_ms) AS nx FROM i),
m AS (SELECT *, least(end_ms + {4 * HOUR}, nx - 1) AS lim FROM n),
e AS (SELECT m.*, (SELECT min(match_time) FROM t WHERE event_type = 'error' AND t.match_id = m.match_id AND t.period = m.period
  AND match_time > end_ms AND match_time <= lim) AS ct FROM m)
SELECT seq_id, end_ms AS end_provider_ms, CASE WHEN ct IS NULL THEN end_ms ELSE least(ct + 60000, lim) END AS end_ms,
  CASE WHEN ct IS NULL THEN 'cierre_bepro' WHEN (SELECT min(team_id) FROM t WHERE t.match_id = e.match_id AND t.period = e.period
    AND event_type = 'error' AND match_time = ct) = 0 THEN 'cierre_recuperacion_propia' ELSE 'cierre_tiro_rival' END AS close_reason FROM e"""


def _membership(spark, sf):
    t = tracking(spark, sf).selectExpr("match_id", "period", "match_time", "CAST(frame AS STRING) AS event_id", "value")
    text = F.expr("""CASE seq_id % 3 WHEN 0 THEN concat('["', seq_id + 3, '","', seq_id + 30, '"]')
      WHEN 1 THEN concat(seq_id + 3, ' , ', seq_id + 6) ELSE '' END""")
    seqs = intervals(spark, sf).withColumn("event_ids", id_list(text)).withColumn("cand_id", F.col("seq_id"))
    hit = sg.events_in_sequence(seqs, t, rules=RULES)
    return hit.groupBy("cand_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max(
        F.col("event_id").cast("long")).alias("last_id"))


QUERIES["membership_join"] = _membership
SQL["membership_join"] = f"""
WITH t AS ({TRACKING_SQL}), i AS ({INTERVALS_SQL}),
ids AS (SELECT seq_id, match_id, unnest(CASE seq_id % 3 WHEN 0 THEN [seq_id + 3, seq_id + 30] WHEN 1 THEN [seq_id + 3, seq_id + 6]
  ELSE CAST([] AS BIGINT[]) END) AS frame FROM i),
u AS (SELECT seq_id, t.frame, value FROM ids JOIN t ON t.frame = ids.frame AND t.match_id = ids.match_id
  UNION ALL SELECT seq_id, t.frame, value FROM i JOIN t ON t.match_id = i.match_id AND t.period = i.period
   AND match_time BETWEEN start_ms AND end_ms WHERE seq_id % 3 = 2)
SELECT seq_id AS cand_id, count(*) AS n, round(sum(value), 3) AS total, max(frame) AS last_id FROM u GROUP BY 1"""


def _seq_metrics(spark, sf):
    out = sg.sequence_metrics(intervals(spark, sf), _frames(spark, sf), seq_id="seq_id", rules=RULES, blocks=blocks(spark, sf))
    return out.select("seq_id", "start_frame", "end_frame", r6("path_m"), r6("gain_m"), r6("x_max_norm"), r6("mean_speed"), "n_frames")


QUERIES["sequence_metrics"] = _seq_metrics
SQL["sequence_metrics"] = f"""
WITH t AS (SELECT *, CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END AS xn, (frame % 10) / 10.0::DOUBLE AS bs FROM ({METRES_SQL})),
i AS ({INTERVALS_SQL}),
a AS (SELECT seq_id, arg_min(frame, (match_time, frame)) AS start_frame, arg_max(frame, (match_time, frame)) AS end_frame,
  arg_min(ball_x_m, (match_time, frame)) AS x0, arg_max(ball_x_m, (match_time, frame)) AS x1, arg_min(ball_y_m, (match_time, frame)) AS y0,
  arg_max(ball_y_m, (match_time, frame)) AS y1, arg_min(xn, (match_time, frame)) AS n0, arg_max(xn, (match_time, frame)) AS n1, max(xn) AS xm,
  avg(bs) AS sp, count(*) AS n FROM t JOIN i ON t.match_id = i.match_id AND t.period = i.period AND match_time BETWEEN start_ms AND end_ms
  GROUP BY 1 HAVING count(*) >= 2)
SELECT seq_id, start_frame, end_frame, round(sqrt((x0 - x1)**2 + (y0 - y1)**2), 6) AS path_m, round(n1 - n0, 6) AS gain_m,
  round(xm, 6) AS x_max_norm, round(sp, 6) AS mean_speed, n AS n_frames FROM a"""


def _first_pass(spark, sf):
    t = tracking(spark, sf).selectExpr(
        "match_id", "period", "match_time", "frame AS event_id", "array(CASE WHEN event_type = 'view' THEN 'pass' ELSE event_type END) AS event_types",
        "x", "y", "ball_x AS to_x", "ball_y AS to_y", "period = 0 AS attacks_high")
    hit = sg.range_join(t, intervals(spark, sf), ["match_id", "period"], "match_time", "start_ms", "end_ms", HOUR,
                        first="event_id", blocks=blocks(spark, sf))
    out = sg.first_pass(hit, ["seq_id"])
    return out.select("seq_id", F.col("first_types")[0].alias("kind"), F.col("first_pass").cast("int").alias("first_pass"), r6("pass_m"), r6("pass_gain_m"))


QUERIES["first_pass"] = _first_pass
SQL["first_pass"] = f"""
WITH t AS ({TRACKING_SQL}), i AS ({INTERVALS_SQL}),
f AS (SELECT seq_id, t.*, row_number() OVER (PARTITION BY seq_id ORDER BY match_time, frame) AS rn FROM t JOIN i ON t.match_id = i.match_id
  AND t.period = i.period AND match_time BETWEEN start_ms AND end_ms)
SELECT seq_id, CASE WHEN event_type = 'view' THEN 'pass' ELSE event_type END AS kind, (event_type = 'view')::INT AS first_pass,
  round(CASE WHEN event_type = 'view' THEN sqrt(((ball_x - x) * 102)**2 + ((ball_y - y) * 64)**2) ELSE 0 END, 6) AS pass_m,
  round(CASE WHEN event_type = 'view' THEN (ball_x - x) * 102 * CASE WHEN period = 0 THEN 1 ELSE -1 END ELSE 0 END, 6) AS pass_gain_m
FROM f WHERE rn = 1"""


def _first_movement(spark, sf):
    t = metres(tracking(spark, sf)).select("match_id", "player_id", "frame", "match_time", "ball_x_m", "ball_y_m")
    out = sg.first_movement(t, ("match_id", "player_id"), blocks(spark, sf), RULES)
    return out.select("match_id", "player_id", "n_ball", "active_ms", "last_ms", r6("kick_m"))


QUERIES["first_movement"] = _first_movement
SQL["first_movement"] = f"""
WITH t AS (SELECT *, lag(ball_x_m) OVER w AS px, lag(ball_y_m) OVER w AS py, row_number() OVER w AS rn FROM ({METRES_SQL})
  WINDOW w AS (PARTITION BY match_id, player_id ORDER BY match_time, frame)),
m AS (SELECT match_id, player_id, count(*) AS n_ball, max(match_time) AS last_ms, min(rn) FILTER (WHERE sqrt((ball_x_m - px)**2 + (ball_y_m - py)**2) > 20) AS mr
  FROM t GROUP BY ALL)
SELECT m.match_id, m.player_id, n_ball, b.match_time AS active_ms, last_ms, round(sqrt((a.ball_x_m - b.ball_x_m)**2 + (a.ball_y_m - b.ball_y_m)**2), 6) AS kick_m
FROM m JOIN t a ON a.match_id = m.match_id AND a.player_id = m.player_id AND a.rn = 1
LEFT JOIN t b ON b.match_id = m.match_id AND b.player_id = m.player_id AND b.rn = m.mr"""


def _number(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("match_id"), "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    out = sg.number_sequences(o, [F.col("day"), F.col("o_orderkey")], blocks=Blocks.equal_depth(o, "day"))
    return out.select("o_orderkey", "seq_id")


QUERIES["number_sequences"] = _number
SQL["number_sequences"] = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS seq_id FROM orders"""


def _attack_summary(spark, sf):
    t = metres(tracking(spark, sf)).withColumn("seq_id", F.col("player_id"))
    seqs = t.select("match_id", "seq_id").distinct()
    shots = t.where("event_type = 'purchase'").selectExpr(
        "match_id", "seq_id", "match_time", "CAST(frame % 2 AS INT) AS on_target", "frame % 5 = 0 AS goal", "value / 400 AS xg",
        "CAST(frame % 900 AS DOUBLE) AS gap_ms", "CASE WHEN frame % 900 = 0 THEN 'dentro_intervalo' ELSE 'tiro_cercano_a_intervalo' END AS assignment")
    out = attack.attack_summary(t, seqs, shots)
    return out.select("match_id", "seq_id", r6("x_start"), r6("x_end"), r6("y_start"), r6("y_end"), r6("gain_x_m"), r6("amplitude_m"), "shot",
                      "on_target", F.col("goal").cast("int").alias("goal"), "shot_ms", "gap_ms", "assignment", r6("xg"), "cross", "loss")


QUERIES["attack_summary"] = _attack_summary
SQL["attack_summary"] = f"""
WITH t AS ({METRES_SQL}),
p AS (SELECT match_id, player_id, arg_min(ball_x_m, (match_time, frame)) AS x0, arg_max(ball_x_m, (match_time, frame)) AS x1,
  arg_min(ball_y_m, (match_time, frame)) AS y0, arg_max(ball_y_m, (match_time, frame)) AS y1, max(ball_y_m) - min(ball_y_m) AS am
  FROM t GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT match_id, player_id, max(frame % 2) AS ot, max((frame % 5 = 0)::INT) AS gl, min(match_time) AS ms, min(frame % 900)::DOUBLE AS gp,
  arg_min(CASE WHEN frame % 900 = 0 THEN 'dentro_intervalo' ELSE 'tiro_cercano_a_intervalo' END, match_time) AS asg, max(value / 400) AS xg
  FROM t WHERE event_type = 'purchase' GROUP BY ALL)
SELECT match_id, player_id AS seq_id, round(x0, 6) AS x_start, round(x1, 6) AS x_end, round(y0, 6) AS y_start, round(y1, 6) AS y_end,
  round(x1 - x0, 6) AS gain_x_m, round(am, 6) AS amplitude_m, (ms IS NOT NULL)::INT AS shot, coalesce(ot, 0)::INT AS on_target, coalesce(gl, 0) AS goal,
  ms AS shot_ms, gp AS gap_ms, asg AS assignment, round(xg, 6) AS xg, (x1 > 76.5 AND (y1 < 12 OR y1 > 52))::INT AS cross, (x1 < 51 AND ms IS NULL)::INT AS loss
FROM p LEFT JOIN s USING (match_id, player_id)"""

RULE_ROWS = """l_orderkey, l_linenumber, l_quantity AS duration_s, CAST(l_linenumber % 6 AS INT) AS n_events, l_extendedprice / 4000 AS action_m,
  l_extendedprice / 8000 - 2 AS action_gain_m, CAST(l_linenumber % 4 AS INT) AS n_passes,
  CASE l_returnflag WHEN 'A' THEN 'forward' WHEN 'N' THEN 'backward' ELSE '' END AS progress_direction,
  l_partkey % 5 = 0 AS has_shot, l_partkey % 10 = 0 AS text_goal, l_partkey % 20 < 12 AS text_target, l_extendedprice / 6000 - 4 AS gain_m,
  CAST(l_suppkey % 103 AS DOUBLE) AS x_max_norm, CAST(l_partkey % 103 AS DOUBLE) AS events_x_max, l_suppkey % 4 = 0 AS first_regain,
  l_suppkey % 4 = 1 AS first_pass, CASE WHEN l_orderkey % 6 = 0 THEN l_quantity * 400 END AS setpiece_ms, l_quantity * 1000 AS end_ms,
  CAST(l_linenumber % 3 AS INT) AS n_after_setpiece, l_quantity - 1 AS provider_s, l_extendedprice / 3000 AS pass_m, l_extendedprice / 7000 - 1 AS pass_gain_m"""


def _rules(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(*_columns(RULE_ROWS))
    return t.withColumn("v", sg.classify_sequence()).groupBy("v.kind", "v.reason", F.col("v.keep").cast("int").alias("keep")).agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"), F.sum("l_linenumber").alias("line_sum"))


def _columns(text):
    return split_columns(text)


QUERIES["classify_rules"] = _rules
SQL["classify_rules"] = f"""
WITH t AS (SELECT {RULE_ROWS}, greatest(l_extendedprice / 6000 - 4, 0) AS gp, greatest(l_suppkey % 103, l_partkey % 103)::DOUBLE AS reach FROM lineitem),
v AS (SELECT *, CASE WHEN duration_s < 1 THEN 'descartada|microaccion_menos_1s' WHEN duration_s > 45 THEN 'descartada|secuencia_demasiado_larga'
 WHEN setpiece_ms IS NOT NULL AND n_after_setpiece >= 2 AND (end_ms - setpiece_ms) / 1000 >= 4 AND (action_m >= 15 OR action_gain_m >= 8 OR n_passes >= 2)
   AND NOT (progress_direction = 'backward' AND action_gain_m < 8) THEN 'balon_parado_con_continuidad|setpiece_con_continuidad_bepro'
 WHEN setpiece_ms IS NOT NULL THEN 'descartada|setpiece_sin_continuidad_posterior'
 WHEN first_regain AND NOT has_shot AND provider_s <= 3 AND n_events <= 2 AND n_passes <= 2 AND NOT (reach >= 0.57 * 102 OR (gp >= 14 AND reach >= 51))
   THEN 'descartada|recuperacion_ligera_sin_amenaza_terminal'
 WHEN first_regain AND duration_s >= 2 AND n_events >= 2 AND action_m >= 10 AND duration_s <= 10 AND (gp >= 8 OR x_max_norm >= 0.62 * 102
   OR (progress_direction = 'forward' AND action_gain_m >= 8)) THEN 'transicion_rapida|origen_recuperacion_rival'
 WHEN first_regain AND n_events >= 3 AND duration_s >= 6 AND action_m >= 10 AND (n_passes >= 2 OR n_events >= 4) THEN 'ataque_elaborado|recuperacion_con_posesion_elaborada'
 WHEN first_regain THEN 'descartada|recuperacion_sin_continuidad_ofensiva'
 WHEN has_shot AND text_goal AND n_events >= 2 THEN CASE WHEN duration_s <= 10 THEN 'transicion_rapida' ELSE 'ataque_elaborado' END || '|finalizacion_gol_con_continuidad'
 WHEN has_shot AND text_target AND duration_s >= 2 AND n_events >= 2 THEN CASE WHEN duration_s <= 10 THEN 'transicion_rapida' ELSE 'ataque_elaborado' END || '|tiro_a_puerta_con_continuidad'
 WHEN ((pass_m >= 15 AND pass_gain_m >= 8) OR (first_pass AND n_passes <= 2 AND action_m >= 15 AND action_gain_m >= 8 AND progress_direction = 'forward'))
   AND (n_events >= 2 OR duration_s >= 2) THEN 'juego_directo|primer_pase_largo_progresivo'
 WHEN n_events >= 3 AND duration_s >= 6 AND action_m >= 10 AND (n_passes >= 2 OR n_events >= 4) THEN 'ataque_elaborado|posesion_bepro_elaborada'
 WHEN n_events >= 3 AND duration_s >= 6 THEN 'descartada|posesion_larga_sin_recorrido_ofensivo' ELSE 'descartada|sin_desarrollo_ofensivo_evaluable' END AS d FROM t)
SELECT split_part(d, '|', 1) AS kind, split_part(d, '|', 2) AS reason, (split_part(d, '|', 1) <> 'descartada')::INT AS keep, count(*) AS n,
  sum(l_orderkey)::BIGINT AS key_sum, sum(l_linenumber)::BIGINT AS line_sum FROM v GROUP BY ALL"""

BLOCK_ROWS = """l_orderkey, l_linenumber, l_quantity AS duration_s, CAST(l_linenumber % 6 AS INT) AS n_rival_events, l_extendedprice / 4000 AS path_m,
  l_tax * 100 AS mean_speed, l_extendedprice / 6000 - 2 AS gain_m, CASE WHEN l_orderkey % 3 = 0 THEN 1 END AS setpiece_ms,
  CAST(l_partkey % 5 AS INT) AS n_ball, CASE WHEN l_partkey % 7 > 0 THEN 5 END AS active_ms, l_quantity / 3 AS active_s,
  CAST(l_suppkey % 4 AS INT) AS n_post_events, l_extendedprice / 5000 AS post_path_m, l_tax * 110 AS post_speed,
  l_extendedprice / 9000 AS post_gain_m, CAST(l_suppkey % 30 AS DOUBLE) AS kick_m, l_suppkey % 2 = 0 AS early_regain"""


def _block_rules(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(*_columns(BLOCK_ROWS))
    return t.withColumn("v", sg.classify_block()).groupBy("v.kind", "v.reason").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"), F.sum("l_linenumber").alias("line_sum"))


QUERIES["classify_block_rules"] = _block_rules
SQL["classify_block_rules"] = f"""
WITH t AS (SELECT {BLOCK_ROWS} FROM lineitem),
v AS (SELECT *, CASE WHEN duration_s < 1 THEN 'descartada|microaccion_menos_1s' WHEN duration_s > 45 THEN 'descartada|secuencia_demasiado_larga'
 WHEN setpiece_ms IS NOT NULL THEN CASE WHEN n_ball < 2 THEN 'descartada|setpiece_sin_movimiento_balon'
   WHEN active_ms IS NULL THEN 'descartada|setpiece_balon_parado_sin_saque_real'
   WHEN active_s < 4 OR n_post_events < 2 THEN 'descartada|setpiece_sin_continuidad_posterior'
   WHEN post_path_m >= 10 THEN 'balon_parado_con_continuidad|' || CASE WHEN kick_m <= 15 THEN 'setpiece_corto_con_elaboracion' ELSE 'setpiece_largo_con_elaboracion' END
   WHEN active_s >= 1 AND post_path_m >= 15 AND post_speed >= 5.5 AND post_gain_m >= 8 THEN 'balon_parado_con_continuidad|setpiece_con_accion_directa_posterior'
   ELSE 'descartada|setpiece_sin_continuidad' END
 WHEN early_regain AND n_rival_events >= 1 AND duration_s >= 1 AND duration_s <= 10 AND path_m >= 10 AND mean_speed >= 5.5 AND gain_m >= 8 THEN 'transicion_rapida|recuperacion_y_amenaza'
 WHEN n_rival_events >= 3 AND duration_s >= 6 AND path_m >= 10 THEN 'ataque_elaborado|elaboracion_juego_fluido'
 WHEN n_rival_events >= 1 AND duration_s >= 1 AND path_m >= 15 AND mean_speed >= 5.5 AND gain_m >= 8 THEN 'juego_directo|desplazamiento_vertical_claro'
 ELSE 'descartada|ruido_sin_continuidad_ni_progresion' END AS d FROM t)
SELECT split_part(d, '|', 1) AS kind, split_part(d, '|', 2) AS reason, count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum,
  sum(l_linenumber)::BIGINT AS line_sum FROM v GROUP BY ALL"""

FINISH_ROWS = """l_orderkey, l_linenumber, l_partkey % 9 = 0 AS goal, CAST(l_partkey % 3 = 0 AS INT) AS shot, CAST(l_suppkey % 2 AS INT) AS on_target,
  CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 5 END AS xg, CAST(l_suppkey % 5 = 0 AS INT) AS cross, CAST(l_suppkey % 3 = 0 AS INT) AS loss, l_quantity * 2 AS x_end"""


def _finish(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(*_columns(FINISH_ROWS))
    return t.select(F.round(threat.finish_score(), 6).alias("finish_score")).groupBy("finish_score").agg(F.count("*").alias("n"))


QUERIES["finish_score"] = _finish
SQL["finish_score"] = f"""WITH t AS (SELECT {FINISH_ROWS} FROM lineitem)
SELECT round(CASE WHEN goal THEN 1 WHEN shot = 1 THEN CASE WHEN xg IS NOT NULL THEN least(greatest(0.3 + 0.7 * xg, 0.3), 1) WHEN on_target = 1 THEN 0.75 ELSE 0.60 END
  WHEN "cross" = 1 THEN 0.30 WHEN loss = 1 THEN CASE WHEN x_end >= 0.66 * 102 THEN 0.20 ELSE 0.10 END ELSE 0.05 END, 6) AS finish_score, count(*) AS n FROM t GROUP BY 1"""


def _trajectories(spark, sf):
    t = metres(tracking(spark, sf)).selectExpr("match_id", "player_id AS seq_id", "period", "frame", "match_time", "ball_x_m", "ball_y_m")
    out = tj.trajectories(t, blocks(spark, sf), ("match_id", "seq_id", "period"))
    return out.select("match_id", "seq_id", "period", F.posexplode("traj").alias("i", "v")).select("match_id", "seq_id", "period", "i", r6("v"))


QUERIES["trajectories"] = _trajectories
SQL["trajectories"] = f"""
WITH t AS (SELECT match_id, period, player_id, row_number() OVER w - 1 AS r, CASE WHEN period = 1 THEN 102 - ball_x_m ELSE ball_x_m END AS px,
  CASE WHEN period = 1 THEN 64 - ball_y_m ELSE ball_y_m END AS py FROM ({METRES_SQL}) WINDOW w AS (PARTITION BY match_id, period, player_id ORDER BY match_time, frame)),
s AS (SELECT match_id, period, player_id, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT *, j * (n - 1) / 19.0::DOUBLE AS a FROM s, range(20) q(j)),
h AS (SELECT *, CAST(floor(a) AS BIGINT) AS f FROM g),
v AS (SELECT h.match_id, h.player_id, h.period, j, a - f AS fr, l.px AS x0, l.py AS y0, coalesce(u.px, l.px) AS x1, coalesce(u.py, l.py) AS y1
  FROM h JOIN t l ON l.match_id = h.match_id AND l.period = h.period AND l.player_id = h.player_id AND l.r = f
  LEFT JOIN t u ON u.match_id = h.match_id AND u.period = h.period AND u.player_id = h.player_id AND u.r = f + 1)
SELECT match_id, player_id AS seq_id, period, (j * 2 + c)::INT AS i, round(CASE WHEN c = 0 THEN x0 + (x1 - x0) * fr ELSE y0 + (y1 - y0) * fr END, 6) AS v
FROM v, range(2) d(c)"""


def _features(spark, sf):
    t = metres(tracking(spark, sf))
    at = F.struct("match_time", "frame")
    seqs = t.groupBy("match_id", F.col("player_id").alias("seq_id")).agg(
        F.min_by("ball_x_m", at).alias("ball_x_m_start"), F.max_by("ball_x_m", at).alias("ball_x_m_end"), F.min_by("ball_y_m", at).alias("ball_y_m_start"),
        F.max_by("ball_y_m", at).alias("ball_y_m_end"), F.sum("value").alias("path_m"), ((F.max("match_time") - F.min("match_time")) / F.lit(1000.0)).alias("duration_s"),
        F.count("*").alias("n_rival_events"), F.count_if(F.col("event_type") == "view").alias("n_passes"), F.avg("value").alias("mean_speed"))
    amp = tj.ball_amplitude(t.withColumn("seq_id", F.col("player_id")))
    out = tj.tactical_features(seqs, amp)
    return out.select("match_id", "seq_id", *[r6(c) for c in out.columns[2:]])


QUERIES["tactical_features"] = _features
SQL["tactical_features"] = f"""
WITH a AS (SELECT match_id, player_id, arg_min(ball_x_m, (match_time, frame)) AS x0, arg_max(ball_x_m, (match_time, frame)) AS x1,
  arg_min(ball_y_m, (match_time, frame)) AS y0, arg_max(ball_y_m, (match_time, frame)) AS y1, sum(value) AS path, (max(match_time) - min(match_time)) / 1000.0::DOUBLE AS dur,
  count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS np, avg(value) AS sp, max(ball_y_m) - min(ball_y_m) AS am FROM ({METRES_SQL}) GROUP BY ALL)
SELECT match_id, player_id AS seq_id, round(coalesce((x1 - x0) / nullif(path, 0), 0), 6) AS verticality, round(coalesce(abs(y1 - y0) / nullif(path, 0), 0), 6) AS horizontality,
  round(coalesce(np / nullif(dur, 0), 0), 6) AS pass_rhythm, round(ln(1 + dur), 6) AS duration_log, round(ln(1 + n), 6) AS events_log, round(ln(1 + path), 6) AS path_log,
  round(sp, 6) AS mean_speed, round(am, 6) AS amplitude_m FROM a"""


def _thin(spark, sf):
    t = metres(tracking(spark, sf)).selectExpr("match_id", "period AS seq_id", "frame", "match_time", "ball_x_m", "ball_y_m")
    out = tj.thin_trajectory(t, 24, blocks(spark, sf))
    return out.select("match_id", "seq_id", "frame", "point_order", r6("ball_x_m"))


QUERIES["thin_trajectory"] = _thin
SQL["thin_trajectory"] = f"""
WITH t AS (SELECT match_id, period, frame, match_time, ball_x_m, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY match_id, period) AS n
  FROM ({METRES_SQL}) WINDOW w AS (PARTITION BY match_id, period ORDER BY match_time, frame)),
k AS (SELECT * FROM t WHERE n <= 24 OR list_contains([CAST(round_even(i * ((n - 1) / 23.0::DOUBLE), 0) AS BIGINT) FOR i IN range(24)], r))
SELECT match_id, period AS seq_id, frame, row_number() OVER (PARTITION BY match_id, period ORDER BY match_time, frame) - 1 AS point_order,
  round(ball_x_m, 6) AS ball_x_m FROM k"""
