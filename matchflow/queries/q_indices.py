"""Scaling, categories, indices, threat, defensive profile and pitch control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import clip
from ..functions.labels import INDEX_LEVELS, threat_level
from ..functions.xt import xt_surface, xt_value
from ..operators import defence, indices as ix, threat
from ..operators.ordered import Blocks
from .adapter import DAY, HOUR, METRES_SQL, ORDERS_SQL, TRACKING_SQL, blocks, metres, r6, sequences_of_orders, split_columns, table, tracking

QUERIES, SQL = {}, {}
M = ["match_id"]


def _q(c, p, w="PARTITION BY match_id"):
    return f"quantile_cont({c}, {p}) OVER ({w})"


def _scaled(c, lo, hi):
    a, b = _q(c, lo), _q(c, hi)
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = {b} THEN 0 WHEN {c} IS NULL THEN NULL ELSE least(greatest(({c} - {a}) / ({b} - {a}), 0), 1) END)"


def _scale(spark, sf):
    o = sequences_of_orders(spark, sf).select("match_id", "seq_id", F.when(F.col("seq_id") % 17 > 0, F.col("idd")).alias("v"))
    out = ix.percentile_scale(o, M, "v", 0.10, 0.90, "scaled")
    return ix.minmax_scale(out, M, "v", "minmax").select("seq_id", r6("scaled"), r6("minmax"))


QUERIES["percentile_scale"] = _scale
SQL["percentile_scale"] = f"""
WITH o AS (SELECT match_id, seq_id, CASE WHEN seq_id % 17 > 0 THEN idd END AS v FROM ({ORDERS_SQL}))
SELECT seq_id, round({_scaled('v', 0.1, 0.9)}, 6) AS scaled,
  round((v - min(v) OVER (PARTITION BY match_id)) / (max(v) OVER (PARTITION BY match_id) - min(v) OVER (PARTITION BY match_id)), 6) AS minmax FROM o"""

CAT_SQL = "CASE WHEN {c} IS NULL THEN NULL " + " ".join(
    f"WHEN {{c}} >= quantile_cont({{c}}, {p}) OVER (PARTITION BY match_id) THEN '{n}'" for p, n in (
        (0.97, "critica"), (0.90, "muy_alta"), (0.75, "alta"), (0.50, "media"))) + " ELSE 'baja' END"
CATEGORISED_SQL = f"SELECT *, {CAT_SQL.format(c='idd')} AS idd_category, {CAT_SQL.format(c='ipo')} AS ipo_category FROM ({ORDERS_SQL})"


def categorised(spark, sf):
    return ix.percentile_category(sequences_of_orders(spark, sf), M, {"idd": "idd_category", "ipo": "ipo_category"})


def _category(spark, sf):
    return categorised(spark, sf).select("seq_id", "idd_category", "ipo_category")


QUERIES["percentile_category"] = _category
SQL["percentile_category"] = f"SELECT seq_id, idd_category, ipo_category FROM ({CATEGORISED_SQL})"

INPUTS = """seq_id, match_id, cluster, y_end * duration_s / 20 AS width_mean, x_max / 7 + idd AS nearest_mean,
  CASE WHEN seq_id % 13 > 0 THEN greatest(minute - 30, CAST(0 AS DOUBLE)) END AS retreat, idd * ipo AS control_rival_mean,
  ipo * ipo AS danger_rival_mean, xt_max, shot * CAST(0.5 AS DOUBLE) + ipo / 4 AS finish_score"""


def _inputs(spark, sf):
    return sequences_of_orders(spark, sf).selectExpr(*split_columns(INPUTS))


def _idd(spark, sf):
    out = ix.idd(_inputs(spark, sf), M)
    return out.select("seq_id", r6("idd"), *[r6(f"sub_{p[0]}") for p in ix.IDD_PARTS], "cause", "second_cause")


QUERIES["idd"] = _idd
_SUBS = {c: f"coalesce({_scaled(c, lo, hi)}, 0)" for c, lo, hi in (
    ("width_mean", 0.10, 0.90), ("nearest_mean", 0.10, 0.90), ("retreat", 0.10, 0.90), ("control_rival_mean", 0.05, 0.95))}
SQL["idd"] = f"""
WITH i AS (SELECT {INPUTS} FROM ({ORDERS_SQL})),
s AS (SELECT seq_id, {', '.join(f'{e} AS s{n}' for n, e in enumerate(_SUBS.values()))} FROM i),
r AS (SELECT *, list_sort([(-s0, 0, 'estructura_anchura'), (-s1, 1, 'presion_distancia'), (-s2, 2, 'estructura_retroceso'),
  (-s3, 3, 'pitch_control_rival')]) AS l FROM s)
SELECT seq_id, round(0.1 * s0 + 0.1 * s1 + 0.3 * s2 + 0.5 * s3, 6) AS idd, round(s0, 6) AS sub_width_mean, round(s1, 6) AS sub_nearest_mean,
  round(s2, 6) AS sub_retreat, round(s3, 6) AS sub_control_rival_mean, struct_extract(l[1], 3) AS cause, struct_extract(l[2], 3) AS second_cause FROM r"""


def _ipo(spark, sf):
    return ix.ipo(_inputs(spark, sf), M).select("seq_id", r6("ipo"))


QUERIES["ipo"] = _ipo
SQL["ipo"] = f"""WITH i AS (SELECT {INPUTS} FROM ({ORDERS_SQL}))
SELECT seq_id, round(0.15 * {_scaled('danger_rival_mean', 0.1, 0.9)} + 0.35 * {_scaled('xt_max', 0.15, 0.85)}
  + 0.5 * {_scaled('finish_score', 0.1, 0.9)}, 6) AS ipo FROM i"""


def _score(spark, sf):
    return sequences_of_orders(spark, sf).select("seq_id", ix.critical_score().alias("score"))


QUERIES["critical_score"] = _score
SQL["critical_score"] = f"SELECT seq_id, round(0.45::DOUBLE * ipo + 0.35::DOUBLE * idd + 0.20::DOUBLE * xt_max, 3) AS score FROM ({ORDERS_SQL})"


def _reference(spark, sf):
    out = ix.index_reference(sequences_of_orders(spark, sf))
    return out.select("metric", r6("p25"), r6("p50"), r6("p75"), "n", "level_1", "level_2", "level_3", "level_4", "method")


QUERIES["index_reference"] = _reference
_CUTS = """c AS (SELECT 'idd' AS metric, quantile_cont(idd, 0.25) AS p25, quantile_cont(idd, 0.5) AS p50, quantile_cont(idd, 0.75) AS p75, 'percentiles' AS method FROM o
  UNION ALL SELECT 'ipo', 0.15::DOUBLE, 0.35::DOUBLE, 0.60::DOUBLE, 'manual')"""
SQL["index_reference"] = f"""
WITH o AS ({ORDERS_SQL}), {_CUTS},
v AS (SELECT 'idd' AS metric, idd AS v FROM o UNION ALL SELECT 'ipo', ipo FROM o)
SELECT metric, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, count(v) AS n, count(*) FILTER (WHERE v < p25) AS level_1,
  count(*) FILTER (WHERE v >= p25 AND v < p50) AS level_2, count(*) FILTER (WHERE v >= p50 AND v < p75) AS level_3,
  count(*) FILTER (WHERE v >= p75) AS level_4, method FROM v JOIN c USING (metric) GROUP BY ALL"""


def _classify(spark, sf):
    o = sequences_of_orders(spark, sf)
    ref = ix.index_reference(o)
    out = ix.classify_rows(ix.classify_rows(o, ref, "idd", "a"), ref, "ipo", "b")
    return out.select("seq_id", F.col("a.level").alias("idd_level"), F.col("a.label").alias("idd_label"), F.col("a.description").alias("idd_text"),
                      F.col("b.level").alias("ipo_level"), F.col("b.label").alias("ipo_label"), threat_level("xt_max").alias("xt_label"))


def _pick(levels, n):
    return "[" + ", ".join("'" + lv[n] + "'" for lv in levels) + "]"


QUERIES["classify_index"] = _classify
SQL["classify_index"] = f"""
WITH o AS ({ORDERS_SQL}), {_CUTS},
l AS (SELECT o.*, 1 + (idd >= a.p25)::INT + (idd >= a.p50)::INT + (idd >= a.p75)::INT AS li, 1 + (ipo >= b.p25)::INT + (ipo >= b.p50)::INT + (ipo >= b.p75)::INT AS lo,
  1 + (xt_max >= 0.05)::INT + (xt_max >= 0.10)::INT + (xt_max >= 0.20)::INT AS lx
  FROM o JOIN c a ON a.metric = 'idd' JOIN c b ON b.metric = 'ipo')
SELECT seq_id, li AS idd_level, {_pick(INDEX_LEVELS['idd'], 0)}[li] AS idd_label, {_pick(INDEX_LEVELS['idd'], 1)}[li] AS idd_text, lo AS ipo_level,
  {_pick(INDEX_LEVELS['ipo'], 0)}[lo] AS ipo_label, ['Baja', 'Moderada', 'Alta', 'Muy peligrosa'][lx] AS xt_label FROM l"""

# ------------------------------------------------------------------------------------------ threat

XT_SQL = "(VALUES " + ", ".join(f"({cx}, {cy}, {v!r}::DOUBLE)" for cx, row in enumerate(xt_surface().tolist())
                                for cy, v in enumerate(row)) + ") AS xt(cx, cy, xt)"


def _cells(x, y):
    return (f"least(greatest(CAST(floor({x} / 102.0::DOUBLE * 32) AS INT), 0), 31)", f"least(greatest(CAST(floor({y} / 64.0::DOUBLE * 24) AS INT), 0), 23)")


def _xt(spark, sf):
    t = metres(tracking(spark, sf))
    return t.select("frame", F.round(xt_value("ball_x_m", "ball_y_m"), 9).alias("xt"))


QUERIES["xt_lookup"] = _xt
SQL["xt_lookup"] = f"""SELECT frame, round(xt, 9) AS xt FROM ({METRES_SQL}) t JOIN {XT_SQL}
  ON cx = {_cells('ball_x_m', 'ball_y_m')[0]} AND cy = {_cells('ball_x_m', 'ball_y_m')[1]}"""


def _threat(spark, sf):
    t = metres(tracking(spark, sf)).withColumn("seq_id", F.col("player_id"))
    out = threat.sequence_threat(t, blocks(spark, sf), ("match_id", "seq_id", "period"))
    return out.select("match_id", "seq_id", "period", *[r6(c) for c in ("xt_start", "xt_end", "xt_gain", "xt_max", "xt_sum", "xt_area", "xt_peak_gain")])


QUERIES["sequence_threat"] = _threat
SQL["sequence_threat"] = f"""
WITH t AS (SELECT match_id, period, player_id, match_time, CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END AS px,
  CASE WHEN period = 0 THEN ball_y_m ELSE 64 - ball_y_m END AS py, lead(match_time) OVER w AS nt, lead(CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END) OVER w AS nx,
  lead(CASE WHEN period = 0 THEN ball_y_m ELSE 64 - ball_y_m END) OVER w AS ny, min(match_time) OVER p AS t0, max(match_time) OVER p AS t1, count(*) OVER p AS n
  FROM ({METRES_SQL}) WINDOW w AS (PARTITION BY match_id, period, player_id ORDER BY match_time), p AS (PARTITION BY match_id, period, player_id)),
g AS (SELECT *, ((match_time - t0) * 19.0::DOUBLE) / (t1 - t0) AS a0, ((nt - t0) * 19.0::DOUBLE) / (t1 - t0) AS a1 FROM t WHERE n >= 3 AND t1 > t0),
v AS (SELECT match_id, period, player_id, j, px + coalesce((nx - px) * (j - a0) / (a1 - a0), 0) AS vx, py + coalesce((ny - py) * (j - a0) / (a1 - a0), 0) AS vy
  FROM g, range(20) q(j) WHERE j >= a0 AND (j < a1 OR a1 IS NULL)),
x AS (SELECT v.*, xt FROM v JOIN {XT_SQL} ON cx = {_cells('vx', 'vy')[0]} AND cy = {_cells('vx', 'vy')[1]}),
s AS (SELECT match_id, period, player_id, arg_min(xt, j) AS a, arg_max(xt, j) AS z, max(xt) AS m, sum(xt) AS s FROM x GROUP BY ALL)
SELECT match_id, player_id AS seq_id, period, round(a, 6) AS xt_start, round(z, 6) AS xt_end, round(z - a, 6) AS xt_gain, round(m, 6) AS xt_max, round(s, 6) AS xt_sum,
  round((s - (a + z) / 2) / 19, 6) AS xt_area, round(m - a, 6) AS xt_peak_gain FROM s"""

# ------------------------------------------------------------------------------------------ defence


def _profile(spark, sf):
    t = metres(tracking(spark, sf)).withColumn("seq_id", F.floor(F.col("match_time") / DAY)).withColumn(
        "match_time", F.floor(F.col("match_time") / HOUR))
    out = defence.defensive_profile(t, Blocks.equal_depth(t, "match_time"))
    long = out.select("match_id", "seq_id", F.posexplode(F.arrays_zip(*defence.PROFILE)).alias("point", "p"))
    return long.select("match_id", "seq_id", "point", *[F.round(f"p.{c}", 6).alias(c) for c in defence.PROFILE])


QUERIES["defensive_profile"] = _profile
_MIRROR = ", ".join(f"CASE WHEN period = 0 THEN {c} ELSE {s} - {c} END AS {n}" for c, s, n in (
    ("x_m", 102, "px"), ("y_m", 64, "py"), ("ball_x_m", 102, "bx"), ("ball_y_m", 64, "qy")))


def _resampled(cols, n, source):
    parts = ", ".join(f"round(l.{c} + CASE WHEN u.r IS NULL THEN 0 ELSE (u.{c} - l.{c}) * (a - f) END, 6) AS {c}" for c in cols)
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY match_id, seq_id ORDER BY hr) - 1 AS r FROM {source}),
n AS (SELECT match_id, seq_id, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT *, j * (n - 1) / {n - 1}.0::DOUBLE AS a, CAST(floor(j * (n - 1) / {n - 1}.0::DOUBLE) AS BIGINT) AS f FROM n, range({n}) q(j) WHERE n >= {{least}})
SELECT g.match_id, g.seq_id, j::INT AS point, {parts} FROM g JOIN r l ON l.match_id = g.match_id AND l.seq_id = g.seq_id AND l.r = f
LEFT JOIN r u ON u.match_id = g.match_id AND u.seq_id = g.seq_id AND u.r = f + 1"""


SQL["defensive_profile"] = f"""
WITH t AS (SELECT match_id, match_time // {DAY} AS seq_id, match_time // {HOUR} AS hr, frame, player_id, {_MIRROR} FROM ({METRES_SQL})),
d AS (SELECT *, sqrt((px - bx)**2 + (py - qy)**2) AS d FROM t),
f AS (SELECT match_id, seq_id, hr, avg(px) AS line, max(py) - min(py) AS width, count(*) FILTER (WHERE d <= 5) AS near5, count(*) FILTER (WHERE d <= 10) AS near10,
  avg(d) AS dist, min(d) AS dist_nearest, arg_min(bx, frame) AS ball_x FROM d GROUP BY ALL),
{_resampled(defence.PROFILE, 20, 'f').format(least=2)}"""

def _control(spark, sf):
    t = metres(tracking(spark, sf)).selectExpr(
        "match_id", f"floor(match_time / {DAY}) AS seq_id", f"floor(match_time / {6 * HOUR}) AS match_time", "period", "team_id", "x_m", "y_m",
        "value / 50 AS speed_smooth", "CAST(frame % 7 AS DOUBLE) AS direction")
    out = defence.pitch_control(t, F.col("team_id") == 0, Blocks.equal_depth(t, "match_time"))
    cols = ["control_own_mean", "control_rival_mean", "danger_own_mean", "danger_rival_mean", "control_lost", "danger_gained"]
    return out.select("match_id", "seq_id", *[r6(c) for c in cols])


QUERIES["pitch_control"] = _control
SQL["pitch_control"] = f"""
WITH t AS (SELECT match_id, match_time // {DAY} AS seq_id, match_time // {6 * HOUR} AS hr, team_id = 0 AS own,
  CASE WHEN period = 0 THEN x_m ELSE 102 - x_m END + value / 50 * cos(frame % 7) * CASE WHEN period = 1 THEN -1 ELSE 1 END * 0.7 AS px,
  CASE WHEN period = 0 THEN y_m ELSE 64 - y_m END + value / 50 * sin(frame % 7) * CASE WHEN period = 1 THEN -1 ELSE 1 END * 0.7 AS py FROM ({METRES_SQL})),
gr AS (SELECT i * 102.0::DOUBLE / 29 AS gx, j * 64.0::DOUBLE / 19 AS gy FROM range(30) a(i), range(20) b(j)),
b AS (SELECT match_id, seq_id, hr, gx, gy, min(CASE WHEN own THEN 0.7 + sqrt((px - gx)**2 + (py - gy)**2) / 5.5 END) AS ta,
  min(CASE WHEN NOT own THEN 0.7 + sqrt((px - gx)**2 + (py - gy)**2) / 5.5 END) AS tb FROM t, gr GROUP BY ALL
  HAVING count(*) FILTER (WHERE own) >= 5 AND count(*) FILTER (WHERE NOT own) >= 5),
p AS (SELECT *, 1 / (1 + exp(-8 * (tb - ta))) AS p, gx >= 102 * 0.6 AND gy >= 64 * 0.15 AND gy <= 64 * 0.85 AS z FROM b),
f AS (SELECT match_id, seq_id, hr, avg(p) AS co, avg(1 - p) AS cr, avg(p) FILTER (WHERE z) AS zo, avg(1 - p) FILTER (WHERE z) AS zr FROM p GROUP BY ALL),
s AS ({{series}})
SELECT match_id, seq_id, round(avg(co), 6) AS control_own_mean, round(avg(cr), 6) AS control_rival_mean, round(avg(zo), 6) AS danger_own_mean,
  round(avg(zr), 6) AS danger_rival_mean, round(arg_min(co, point) - arg_max(co, point), 6) AS control_lost,
  round(arg_max(zr, point) - arg_min(zr, point), 6) AS danger_gained FROM s GROUP BY ALL"""
_ctes, _tail = _resampled(("co", "cr", "zo", "zr"), 20, "f").format(least=3).replace(", 6) AS c", ", 12) AS c").replace(", 6) AS z", ", 12) AS z").split("\nSELECT", 1)
SQL["pitch_control"] = SQL["pitch_control"].replace("s AS ({series})", f"{_ctes},\ns AS (SELECT{_tail})")
