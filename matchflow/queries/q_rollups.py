"""Roll-ups of the sequence table: orders are the sequences, priorities the matches, segments the clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import LANE_CODES, LANE_NAMES
from ..functions.labels import CATEGORIES, INDEX_LEVELS, MINUTE_EDGES, MINUTE_LABELS
from ..operators import reports, rollups as ru
from ..operators.indices import classify_rows, critical_score, index_reference
from .adapter import METRES_SQL, ORDERS_SQL, TRACKING_SQL, metres, r6, sequences_of_orders, tracking
from .q_indices import CATEGORISED_SQL, _CUTS, _pick, categorised

QUERIES, SQL = {}, {}
EXTRA = """cluster AS typology, x_max AS x_max_norm, passes AS n_passes, idd * ipo AS control_rival_mean, ipo * ipo AS danger_rival_mean,
  CASE seq_id % 3 WHEN 0 THEN 'ataque_elaborado' WHEN 1 THEN 'juego_directo' ELSE 'transicion_rapida' END AS sequence_type"""
SCORE = "round(0.45::DOUBLE * ipo + 0.35::DOUBLE * idd + 0.20::DOUBLE * xt_max, 3)"
SEQ_SQL = f"SELECT *, {EXTRA}, {SCORE} AS score FROM ({CATEGORISED_SQL})"


def seqs(spark, sf):
    return categorised(spark, sf).selectExpr(
        "*", "cluster AS typology", "x_max AS x_max_norm", "passes AS n_passes", "idd * ipo AS control_rival_mean",
        "ipo * ipo AS danger_rival_mean", "CASE seq_id % 3 WHEN 0 THEN 'ataque_elaborado' WHEN 1 THEN 'juego_directo' ELSE 'transicion_rapida' END AS sequence_type"
    ).withColumn("score", critical_score())


def plain(spark, sf):
    """The same rows without the percentile categories."""
    return sequences_of_orders(spark, sf).selectExpr(
        "*", "cluster AS typology", "x_max AS x_max_norm", "passes AS n_passes", "idd * ipo AS control_rival_mean", "ipo * ipo AS danger_rival_mean",
        "CASE seq_id % 3 WHEN 0 THEN 'ataque_elaborado' WHEN 1 THEN 'juego_directo' ELSE 'transicion_rapida' END AS sequence_type").withColumn("score", critical_score())


PLAIN_SQL = f"SELECT *, {EXTRA}, {SCORE} AS score FROM ({ORDERS_SQL})"
_LANE = "CASE " + " ".join(f"WHEN y_end < 64 * {c} THEN '{n}'" for c, n in zip((0.2, 0.4, 0.6, 0.8), LANE_NAMES)) + f" ELSE '{LANE_NAMES[4]}' END"
_LANE_CODE = "CASE " + " ".join(f"WHEN y_end < 64 * {c} THEN '{n}'" for c, n in zip((0.2, 0.4, 0.6, 0.8), LANE_CODES)) + f" ELSE '{LANE_CODES[4]}' END"


def _bin_sql(col, right):
    parts = []
    for i, n in enumerate(MINUTE_LABELS):
        lo, hi = MINUTE_EDGES[i], MINUTE_EDGES[i + 1]
        parts.append(f"WHEN {col} {'>=' if i == 0 or not right else '>'} {lo} AND {col} {'<=' if right else '<'} {hi} THEN '{n}'")
    return "CASE " + " ".join(parts) + " END"


def put(name, fn, sql):
    QUERIES[name], SQL[name] = fn, sql


put("category_matrix", lambda s, d: ru.category_matrix(seqs(s, d)),
    f"""WITH s AS ({SEQ_SQL}), f AS (SELECT DISTINCT match_id, c AS idd_category FROM s, (VALUES {', '.join(f"('{c}')" for c in CATEGORIES)}) v(c))
SELECT f.match_id, f.idd_category, {', '.join(f"count(*) FILTER (WHERE ipo_category = '{c}') AS {c}" for c in CATEGORIES)}
FROM f LEFT JOIN s ON s.match_id = f.match_id AND s.idd_category = f.idd_category GROUP BY ALL""")

put("risk_summary", lambda s, d: ru.risk_summary(plain(s, d)),
    f"""SELECT match_id, cluster, count(*) AS sequences, round(avg(idd), 3) AS idd_mean, round(avg(ipo), 3) AS ipo_mean, sum(shot)::BIGINT AS shots,
  sum(on_target)::BIGINT AS shots_on_target FROM ({PLAIN_SQL}) GROUP BY ALL""")

_PATTERN = f"""p AS (SELECT match_id, cluster, count(*) AS n_sequences, avg(idd) AS idd_mean, avg(ipo) AS ipo_mean, sum(shot)::BIGINT AS shots,
  sum(on_target)::BIGINT AS shots_on_target FROM s GROUP BY ALL),
mc AS (SELECT match_id, cluster, arg_min(cause, (-n, cause)) AS main_cause FROM (SELECT match_id, cluster, cause, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL)"""


def _patterns(s, d):
    out = ru.pattern_table(seqs(s, d))
    return out.select("match_id", "cluster", "n_sequences", r6("idd_mean"), r6("ipo_mean"), "shots", "shots_on_target", "main_cause",
                      "idd_category_mode", "ipo_category_mode", "risk")


put("pattern_table", _patterns, f"""WITH s AS ({SEQ_SQL}), {_PATTERN},
a AS (SELECT match_id, cluster, arg_min(c, (-n, c)) AS m FROM (SELECT match_id, cluster, idd_category AS c, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL),
b AS (SELECT match_id, cluster, arg_min(c, (-n, c)) AS m FROM (SELECT match_id, cluster, ipo_category AS c, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL)
SELECT p.match_id, p.cluster, n_sequences, round(idd_mean, 6) AS idd_mean, round(ipo_mean, 6) AS ipo_mean, shots, shots_on_target, main_cause,
  a.m AS idd_category_mode, b.m AS ipo_category_mode, CASE WHEN (idd_mean + ipo_mean) / 2 <= 0.33 THEN 'bajo' WHEN (idd_mean + ipo_mean) / 2 <= 0.66 THEN 'medio' ELSE 'alto' END AS risk
FROM p JOIN mc USING (match_id, cluster) JOIN a USING (match_id, cluster) JOIN b USING (match_id, cluster)""")

put("cluster_summary", lambda s, d: ru.cluster_summary(plain(s, d)),
    f"""SELECT match_id, cluster, count(*) AS sequences, sum(shot)::BIGINT AS shots, sum(on_target)::BIGINT AS shots_on_target, round(avg(duration_s), 1) AS duration_mean,
  round(count(*) / sum(count(*)) OVER (PARTITION BY match_id) * 100, 1) AS share_pct, round(avg(shot) * 100, 1) AS shot_pct FROM ({PLAIN_SQL}) GROUP BY match_id, cluster""")

_DAMAGE = "idd_category = 'baja' AND ipo_category IN ('muy_alta', 'critica')"
_CHAOS = "ipo_category = 'baja' AND idd_category IN ('muy_alta', 'critica')"
put("damage_causes", lambda s, d: ru.damage_causes(seqs(s, d)),
    f"""SELECT match_id, cause, count(*) AS frequency, round(count(*) / sum(count(*)) OVER (PARTITION BY match_id) * 100, 1) AS share_pct
FROM ({SEQ_SQL}) WHERE {_DAMAGE} GROUP BY match_id, cause""")
put("damage_zones", lambda s, d: ru.damage_zones(seqs(s, d)),
    f"SELECT match_id, {_LANE_CODE} AS zone, cluster, count(*) AS n FROM ({SEQ_SQL}) WHERE {_DAMAGE} GROUP BY ALL")
put("extreme_profiles", lambda s, d: ru.extreme(seqs(s, d), "damage").select("seq_id", F.lit("damage").alias("kind")).unionByName(
    ru.extreme(seqs(s, d), "chaos").select("seq_id", F.lit("chaos").alias("kind"))),
    f"WITH s AS ({SEQ_SQL}) SELECT seq_id, 'damage' AS kind FROM s WHERE {_DAMAGE} UNION ALL SELECT seq_id, 'chaos' FROM s WHERE {_CHAOS}")
put("ranking", lambda s, d: ru.ranking(plain(s, d)).select("match_id", "seq_id", "cluster", r6("ipo"), r6("idd"), "cause"),
    f"""SELECT match_id, seq_id, cluster, round(ipo, 6) AS ipo, round(idd, 6) AS idd, cause FROM ({PLAIN_SQL})
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ipo DESC, idd DESC, seq_id) <= 15""")
put("extremes_top", lambda s, d: ru.extremes_top(seqs(s, d), "chaos").select("match_id", "seq_id", "cluster", F.round("idd", 3).alias("idd"), F.round("ipo", 3).alias("ipo")),
    f"""SELECT match_id, seq_id, cluster, round(idd, 3) AS idd, round(ipo, 3) AS ipo FROM ({SEQ_SQL}) WHERE {_CHAOS}
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY seq_id) <= 8""")
put("critical_sequences", lambda s, d: ru.critical_sequences(plain(s, d), 5).select("match_id", "seq_id", "score"),
    f"""SELECT match_id, seq_id, score FROM ({PLAIN_SQL}) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY score DESC, ipo DESC, seq_id) <= 5""")


def _kpis(s, d):
    q = seqs(s, d)
    totals = q.groupBy("match_id").agg(F.sum("shot").alias("shots_rival"), F.sum("goal").alias("shots_assigned"), F.sum("on_target").alias("shots_on_target_rival"))
    return ru.match_kpis(q, totals, ru.pattern_table(q))


put("match_kpis", _kpis, f"""WITH s AS ({SEQ_SQL}), {_PATTERN},
t AS (SELECT match_id, count(*) AS n, sum(shot)::BIGINT AS sr, sum(goal)::BIGINT AS sa, sum(on_target)::BIGINT AS st, round(avg(idd), 6) AS idd, round(avg(ipo), 6) AS ipo FROM s GROUP BY 1),
cc AS (SELECT match_id, arg_min(cluster, (-n, cluster)) AS c FROM (SELECT match_id, cluster, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1),
ca AS (SELECT match_id, arg_min(cause, (-n, cause)) AS c FROM (SELECT match_id, cause, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1),
z AS (SELECT match_id, zone, cluster FROM (SELECT match_id, {_LANE_CODE} AS zone, cluster, count(*) AS n FROM s WHERE {_DAMAGE} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY n DESC, zone, cluster) = 1),
w AS (SELECT t.*, 'C' || cc.c AS common, ca.c AS cause, z.zone, 'C' || z.cluster AS top FROM t JOIN cc USING (match_id) JOIN ca USING (match_id) LEFT JOIN z USING (match_id))
SELECT match_id, 'Secuencias rivales' AS kpi, n::VARCHAR AS value FROM w UNION ALL SELECT match_id, 'Tiros Bepro rival', sr::VARCHAR FROM w
UNION ALL SELECT match_id, 'Tiros en secuencias', sa::VARCHAR FROM w UNION ALL SELECT match_id, 'Tiros a puerta rival', st::VARCHAR FROM w
UNION ALL SELECT match_id, 'IDD medio', idd::VARCHAR FROM w UNION ALL SELECT match_id, 'IPO medio', ipo::VARCHAR FROM w
UNION ALL SELECT match_id, 'Cluster mas repetido', common FROM w UNION ALL SELECT match_id, 'Zona/carril mas danino', zone FROM w
UNION ALL SELECT match_id, 'Foco defensivo', cause FROM w UNION ALL SELECT match_id, 'Cluster prioritario', top FROM w""")


def _taxonomy(s, d):
    t = metres(tracking(s, d)).withColumn("cluster", F.col("player_id") % 4)
    ball = t.selectExpr("match_id", "cluster", "CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END AS ball_x_norm",
                        "CASE WHEN period = 0 THEN ball_y_m ELSE 64 - ball_y_m END AS ball_y_norm")
    q = t.selectExpr("match_id", "cluster", "(x_m - ball_x_m) / 4 + cluster * 9 - 10 AS gain_x_m", "value / 3 AS duration_s", "y_m / 2 AS amplitude_m",
                     "CAST(frame % 5 = cluster AS INT) AS shot", "CAST(frame % 11 < cluster AS INT) AS cross", "CAST(frame % 10 < 7 AS INT) AS loss")
    out = ru.taxonomy_profile(q, ball)
    return out.select("match_id", "cluster", "n_sequences", r6("x_typical"), r6("y_typical"), r6("gain_median"), r6("duration_median"), r6("amplitude_median"),
                      r6("shot_share"), r6("cross_share"), r6("loss_share"), "tactical_label", "detailed_label")


put("taxonomy", _taxonomy, f"""
WITH t AS (SELECT *, player_id % 4 AS cluster, CASE WHEN period = 0 THEN ball_x_m ELSE 102 - ball_x_m END AS bx, CASE WHEN period = 0 THEN ball_y_m ELSE 64 - ball_y_m END AS bq FROM ({METRES_SQL})),
a AS (SELECT match_id, cluster, count(*) AS n, quantile_cont(bx, 0.5) AS xt, quantile_cont(bq, 0.5) AS yt, quantile_cont((x_m - ball_x_m) / 4 + cluster * 9 - 10, 0.5) AS g,
  quantile_cont(value / 3, 0.5) AS du, quantile_cont(y_m / 2, 0.5) AS am, avg((frame % 5 = cluster)::INT) AS sp, avg((frame % 11 < cluster)::INT) AS cp, avg((frame % 10 < 7)::INT) AS lp FROM t GROUP BY ALL),
l AS (SELECT *, 'zona_' || CASE WHEN xt < 25.5 THEN 1 WHEN xt < 51 THEN 2 WHEN xt < 76.5 THEN 3 ELSE 4 END AS zn,
  'carril_' || CASE WHEN yt < 12.8 THEN 1 WHEN yt < 25.6 THEN 2 WHEN yt < 38.4 THEN 3 WHEN yt < 51.2 THEN 4 ELSE 5 END AS ln,
  CASE WHEN g > 10 THEN 'progresion_vertical' WHEN g < -8 THEN 'retroceso' ELSE 'circulacion' END AS mv,
  CASE WHEN am > 28.8 THEN 'cambio_orientacion' WHEN du > 13 THEN 'posesion_larga' ELSE 'ataque_corto' END AS sh,
  CASE WHEN sp >= 0.2 THEN 'alta_amenaza' WHEN cp >= 0.1 THEN 'amenaza_centro' WHEN lp >= 0.65 THEN 'baja_amenaza' ELSE 'amenaza_media' END AS dg FROM a)
SELECT match_id, cluster, n AS n_sequences, round(xt, 6) AS x_typical, round(yt, 6) AS y_typical, round(g, 6) AS gain_median, round(du, 6) AS duration_median,
  round(am, 6) AS amplitude_median, round(sp, 6) AS shot_share, round(cp, 6) AS cross_share, round(lp, 6) AS loss_share, zn || '_' || ln || '_' || mv || '_' || dg AS tactical_label,
  zn || '_' || ln || '_' || mv || '_' || sh || '_' || dg AS detailed_label FROM l""")

put("lane_summary", lambda s, d: ru.lane_summary(plain(s, d)),
    f"""WITH s AS (SELECT match_id, {_LANE} AS lane FROM ({PLAIN_SQL})), f AS (SELECT DISTINCT match_id, o AS lane_order, n AS lane FROM s, (VALUES
{', '.join(f"({i}, '{n}')" for i, n in enumerate(LANE_NAMES))}) v(o, n))
SELECT f.match_id, lane_order, f.lane, count(s.lane) AS sequences FROM f LEFT JOIN s ON s.match_id = f.match_id AND s.lane = f.lane GROUP BY ALL""")
put("most_damaged_lane", lambda s, d: ru.most_damaged_lane(plain(s, d)),
    f"SELECT match_id, arg_min(lane, (-w, lane)) AS most_damaged_lane FROM (SELECT match_id, {_LANE} AS lane, sum(score) AS w FROM ({PLAIN_SQL}) GROUP BY ALL) GROUP BY 1")
put("survival", lambda s, d: ru.survival_by_cluster(plain(s, d)).select("match_id", "cluster", r6("last_third_pct"), r6("final_zone_pct")),
    f"""SELECT match_id, cluster, round(avg((x_max >= 102 * 2 / 3.0::DOUBLE)::INT) * 100, 6) AS last_third_pct,
  round(avg((x_max >= 102 * 0.9::DOUBLE)::INT) * 100, 6) AS final_zone_pct FROM ({PLAIN_SQL}) GROUP BY ALL""")


def _interval(right):
    def run(s, d):
        q = plain(s, d)
        out = ru.interval_summary(q.where("cluster = 'BUILDING'"), right_closed=right, baseline=q)
        return out.select("match_id", "interval_order", "interval", "sequences", r6("idd_mean"), r6("ipo_mean"), "shots", "on_targets", "goals",
                          r6("idd_baseline"), r6("ipo_baseline"))
    return run


for _name, _right in (("interval_summary_right", True), ("interval_summary_left", False)):
    put(_name, _interval(_right), f"""
WITH s AS (SELECT *, {_bin_sql('minute', _right)} AS interval FROM ({PLAIN_SQL})), f AS (SELECT DISTINCT match_id, o AS interval_order, n AS interval FROM s, (VALUES
{', '.join(f"({i}, '{n}')" for i, n in enumerate(MINUTE_LABELS))}) v(o, n)),
a AS (SELECT match_id, interval, count(*) AS n, avg(idd) AS i, avg(ipo) AS o, sum(shot) AS sh, sum(on_target) AS ot, sum(goal) AS g FROM s WHERE cluster = 'BUILDING' GROUP BY ALL),
b AS (SELECT match_id, interval, avg(idd) AS i, avg(ipo) AS o FROM s GROUP BY ALL)
SELECT f.match_id, interval_order, f.interval, coalesce(n, 0) AS sequences, round(a.i, 6) AS idd_mean, round(a.o, 6) AS ipo_mean, coalesce(sh, 0)::BIGINT AS shots,
  coalesce(ot, 0)::BIGINT AS on_targets, coalesce(g, 0)::BIGINT AS goals, round(b.i, 6) AS idd_baseline, round(b.o, 6) AS ipo_baseline
FROM f LEFT JOIN a ON a.match_id = f.match_id AND a.interval = f.interval LEFT JOIN b ON b.match_id = f.match_id AND b.interval = f.interval""")

put("heatmap_bins", lambda s, d: ru.heatmap_bins(metres(tracking(s, d)).withColumn("c", F.col("player_id") % 4), ("c",), x="ball_x_m", y="ball_y_m"),
    f"""SELECT player_id % 4 AS c, least(CAST(floor(ball_x_m / 102.0::DOUBLE * 24) AS INT), 23) AS bin_x, least(CAST(floor(ball_y_m / 64.0::DOUBLE * 16) AS INT), 15) AS bin_y,
  count(*) AS n FROM ({METRES_SQL}) GROUP BY ALL""")


def _smooth(s, d):
    t = metres(tracking(s, d)).withColumn("c", F.col("player_id") % 4)
    hist = ru.heatmap_bins(t, ("c",), (58, 38), "ball_x_m", "ball_y_m")
    return ru.smooth_heatmap(hist, ("c",)).select("c", "bin_x", "bin_y", r6("v"))


put("heatmap_smooth", _smooth, f"""
WITH h AS (SELECT player_id % 4 AS c, least(CAST(floor(ball_x_m / 102.0::DOUBLE * 58) AS INT), 57) AS bx, least(CAST(floor(ball_y_m / 64.0::DOUBLE * 38) AS INT), 37) AS bq,
  count(*)::DOUBLE AS v FROM ({METRES_SQL}) GROUP BY ALL),
k0 AS (SELECT o, exp(-0.5 * (o / 1.35::DOUBLE)**2) AS w FROM range(-5, 6) r(o)), k AS (SELECT o, w / (SELECT sum(w) FROM k0) AS w FROM k0),
x AS (SELECT c, CASE WHEN (bx + o + 116) % 116 >= 58 THEN 115 - (bx + o + 116) % 116 ELSE (bx + o + 116) % 116 END AS bx, bq, sum(v * w) AS v FROM h, k GROUP BY ALL)
SELECT c, bx::INT AS bin_x, (CASE WHEN (bq + o + 76) % 76 >= 38 THEN 75 - (bq + o + 76) % 76 ELSE (bq + o + 76) % 76 END)::INT AS bin_y, round(sum(v * w), 6) AS v FROM x, k GROUP BY ALL""")


def _validation(s, d):
    t = tracking(s, d).selectExpr("match_id", "frame % 40 AS seq_id", "team_id", "CASE WHEN frame % 3 = 0 THEN 1 ELSE 0 END AS possessor")
    teams = t.select("match_id").distinct().selectExpr("match_id", "0 AS own_team", "1 AS rival_team")
    out = ru.possession_validation(t, teams)
    return out.select("match_id", "seq_id", "frames_held", "frames_rival", "frames_own", r6("rival_share"), F.col("rival_ok").cast("int").alias("rival_ok"))


put("possession_validation", _validation, f"""
WITH t AS (SELECT match_id, frame % 40 AS seq_id, count(*) AS h, count(*) FILTER (WHERE team_id = 1) AS r, count(*) FILTER (WHERE team_id = 0) AS o
  FROM ({TRACKING_SQL}) WHERE frame % 3 = 0 GROUP BY ALL)
SELECT match_id, seq_id, h AS frames_held, r AS frames_rival, o AS frames_own, round(r / h, 6) AS rival_share, (r > 0 AND r >= o)::INT AS rival_ok FROM t""")


def _typology(s, d):
    out = ru.typology_summary(seqs(s, d))
    return out.select("match_id", "typology", "sequences", "idd_mean", "idd_max", "ipo_mean", "ipo_max", "xt_max", "control_rival_mean", "danger_rival_mean",
                      "shots", "shots_on_target", "high_danger", "high_disorder")


put("typology_summary", _typology, f"""
SELECT match_id, typology, count(*) AS sequences, round(avg(idd), 3) AS idd_mean, round(max(idd), 3) AS idd_max, round(avg(ipo), 3) AS ipo_mean, round(max(ipo), 3) AS ipo_max,
  round(max(xt_max), 3) AS xt_max, round(avg(control_rival_mean), 3) AS control_rival_mean, round(avg(danger_rival_mean), 3) AS danger_rival_mean, sum(shot)::BIGINT AS shots,
  sum(on_target)::BIGINT AS shots_on_target, count(*) FILTER (WHERE ipo_category IN ('muy_alta', 'critica')) AS high_danger,
  count(*) FILTER (WHERE idd_category IN ('muy_alta', 'critica')) AS high_disorder FROM ({SEQ_SQL}) GROUP BY ALL""")


def _summary(s, d):
    out = ru.summary_metrics(plain(s, d))
    return out.select("match_id", "sequences", "shots", "shots_on_target", "goals", r6("duration_mean"), r6("passes_mean"), r6("idd_mean"), r6("ipo_mean"), r6("idd_max"),
                      r6("ipo_max"), r6("xt_max"), "last_third_entries", "most_frequent", "most_dangerous", "most_damaged_lane", "main_cause", "most_attacked", "most_attacked_n")


put("summary_metrics", _summary, f"""
WITH s AS (SELECT *, {_LANE} AS lane, {_bin_sql('minute', True)} AS bin FROM ({PLAIN_SQL})),
b AS (SELECT match_id, count(*) AS sequences, sum(shot)::BIGINT AS shots, sum(on_target)::BIGINT AS shots_on_target, sum(goal)::BIGINT AS goals, round(avg(duration_s), 6) AS duration_mean,
  round(avg(passes), 6) AS passes_mean, round(avg(idd), 6) AS idd_mean, round(avg(ipo), 6) AS ipo_mean, round(max(idd), 6) AS idd_max, round(max(ipo), 6) AS ipo_max,
  round(max(xt_max), 6) AS xt_max, count(*) FILTER (WHERE x_max >= 68) AS last_third_entries FROM s GROUP BY 1),
f AS (SELECT match_id, arg_min(typology, (-n, typology)) AS v FROM (SELECT match_id, typology, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1),
g AS (SELECT match_id, arg_min(typology, (-n, typology)) AS v FROM (SELECT match_id, typology, avg(ipo) AS n FROM s GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1),
l AS (SELECT match_id, arg_min(lane, (-n, lane)) AS v FROM (SELECT match_id, lane, sum(score) AS n FROM s GROUP BY ALL) GROUP BY 1),
c AS (SELECT match_id, arg_min(cause, (-n, cause)) AS v FROM (SELECT match_id, cause, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1),
t AS (SELECT match_id, arg_min(bin, (-n, m)) AS v, max(n) AS n FROM (SELECT match_id, bin, count(*) AS n, min(minute) AS m FROM s WHERE bin IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT b.*, f.v AS most_frequent, g.v AS most_dangerous, l.v AS most_damaged_lane, c.v AS main_cause, t.v AS most_attacked, t.n AS most_attacked_n
FROM b JOIN f USING (match_id) JOIN g USING (match_id) JOIN l USING (match_id) JOIN c USING (match_id) JOIN t USING (match_id)""")


def _diff(s, d):
    out = ru.diff_vs_mean(plain(s, d))
    return out.select("match_id", "typology", r6("idd_diff_pct"), r6("ipo_diff_pct"))


put("diff_vs_mean", _diff, f"""
WITH s AS ({PLAIN_SQL}), m AS (SELECT match_id, avg(idd) AS i, avg(ipo) AS o FROM s GROUP BY 1)
SELECT s.match_id, typology, round((avg(idd) / i - 1) * 100, 6) AS idd_diff_pct, round((avg(ipo) / o - 1) * 100, 6) AS ipo_diff_pct FROM s JOIN m ON s.match_id = m.match_id GROUP BY s.match_id, typology, i, o""")
put("sequence_vs_typology", lambda s, d: ru.sequence_vs_typology(plain(s, d)).select("seq_id", r6("idd_vs_pct"), r6("ipo_vs_pct"), r6("xt_max_vs_pct")),
    f"""SELECT seq_id, round((idd / avg(idd) OVER w - 1) * 100, 6) AS idd_vs_pct, round((ipo / avg(ipo) OVER w - 1) * 100, 6) AS ipo_vs_pct,
  round((xt_max / avg(xt_max) OVER w - 1) * 100, 6) AS xt_max_vs_pct FROM ({PLAIN_SQL}) WINDOW w AS (PARTITION BY match_id, typology)""")
put("passes_by_typology", lambda s, d: ru.passes_by_typology(plain(s, d)).select("match_id", "typology", r6("passes_mean"), "sequences"),
    f"SELECT match_id, typology, round(avg(passes), 6) AS passes_mean, count(*) AS sequences FROM ({PLAIN_SQL}) GROUP BY ALL")
put("top_pattern", lambda s, d: ru.top_pattern(plain(s, d), "idd").select("match_id", "top_typology", r6("top_typology_mean")),
    f"""SELECT match_id, arg_max(typology, m) AS top_typology, round(max(m), 6) AS top_typology_mean FROM (SELECT match_id, typology, avg(idd) AS m FROM ({PLAIN_SQL}) GROUP BY ALL
HAVING count(*) >= 2) GROUP BY 1""")


def _typology_filter(s, d):
    q = plain(s, d).withColumn("typology", F.concat(F.lit("Tipología "), (F.col("seq_id") % 12 + 1).cast("string")))
    kept = ru.filter_typology(q, "Tipología 3").groupBy("match_id").agg(F.count("*").alias("n"))
    return ru.typology_options(q).select("match_id", "typology", "place").join(kept, "match_id")


put("filter_typology", _typology_filter, f"""
WITH s AS (SELECT match_id, seq_id % 12 + 1 AS k FROM ({PLAIN_SQL})), n AS (SELECT match_id, count(*) AS n FROM s WHERE k = 3 GROUP BY 1)
SELECT DISTINCT s.match_id, 'Tipología ' || k AS typology, k::INT AS place, n FROM s JOIN n USING (match_id)""")


def _display(s, d):
    q = plain(s, d)
    ref = index_reference(q)
    q = classify_rows(classify_rows(q, ref, "idd", "idd_level"), ref, "ipo", "ipo_level")
    return ru.display_table(q, [F.col("score").desc(), F.col("seq_id")])


put("display_table", _display, f"""
WITH o AS ({PLAIN_SQL}), {_CUTS},
l AS (SELECT o.*, 1 + (idd >= a.p25)::INT + (idd >= a.p50)::INT + (idd >= a.p75)::INT AS li, 1 + (ipo >= b.p25)::INT + (ipo >= b.p50)::INT + (ipo >= b.p75)::INT AS lo
  FROM o JOIN c a ON a.metric = 'idd' JOIN c b ON b.metric = 'ipo')
SELECT match_id, seq_id, typology, minute, duration_s, {_pick(INDEX_LEVELS['idd'], 0)}[li] || ' (' || printf('%.3f', idd) || ')' AS idd_text,
  {_pick(INDEX_LEVELS['ipo'], 0)}[lo] || ' (' || printf('%.3f', ipo) || ')' AS ipo_text, xt_max, shot || ' / ' || on_target || ' / ' || goal AS finish, cause
FROM l QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY score DESC, seq_id) <= 12""")


def _pick_typology(s, d):
    q = plain(s, d)
    picked = ru.pick_typology(ru.typology_summary(q, goals=True))
    labels = q.select("match_id", "typology").distinct().selectExpr("match_id", "typology", "concat('zona_', length(typology) % 4 + 1) AS zone",
                                                                   "concat('carril_', length(typology) % 5 + 1) AS lane")
    return ru.critical_typology_context(q, picked, labels).select("match_id", "typology", "sequences", "main_cause", "zone", "lane")


put("pick_typology", _pick_typology, f"""
WITH s AS ({PLAIN_SQL}), p AS (SELECT match_id, arg_max(typology, (m, n, c)) AS t FROM (SELECT match_id, typology, avg(ipo) AS m, avg(idd) AS n, count(*) AS c FROM s GROUP BY ALL) GROUP BY 1),
c AS (SELECT s.match_id, cause, count(*) AS n FROM s JOIN p ON s.match_id = p.match_id AND typology = t GROUP BY ALL),
k AS (SELECT match_id, arg_min(cause, (-n, cause)) AS main_cause, sum(n)::BIGINT AS sequences FROM c GROUP BY 1)
SELECT p.match_id, t AS typology, sequences, main_cause, CASE length(t) % 4 + 1 WHEN 1 THEN 'Zona 1 - Inicio de campo propio' WHEN 2 THEN 'Zona 2 - Zona media'
  WHEN 3 THEN 'Zona 3 - Ultimo tercio' ELSE 'Zona 4 - Zona de remate' END AS zone, CASE length(t) % 5 + 1 WHEN 1 THEN 'Banda izquierda' WHEN 2 THEN 'Half-space izquierdo'
  WHEN 3 THEN 'Carril central' WHEN 4 THEN 'Half-space derecho' ELSE 'Banda derecha' END AS lane FROM p JOIN k USING (match_id)""")


def _pattern_name(s, d):
    q = plain(s, d).withColumn("cluster", F.col("seq_id") % 6).withColumn("sequence_type", F.when(F.col("cluster") < 3, "juego_directo").otherwise(F.col("sequence_type")))
    labels = q.select("match_id", "cluster").distinct().selectExpr("match_id", "cluster", "concat('zona_', cluster % 2 + 1) AS zone", "concat('carril_', cluster % 2 + 2) AS lane")
    return ru.pattern_name(q, labels).select("match_id", "cluster", "pattern")


put("pattern_name", _pattern_name, f"""
WITH s AS (SELECT match_id, seq_id % 6 AS cluster, CASE WHEN seq_id % 6 < 3 THEN 'juego_directo' ELSE sequence_type END AS k FROM ({PLAIN_SQL})),
m AS (SELECT match_id, cluster, arg_min(k, (-n, k)) AS k FROM (SELECT match_id, cluster, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL),
b AS (SELECT *, CASE k WHEN 'juego_directo' THEN 'Juego directo vertical' WHEN 'transicion_rapida' THEN 'Transicion tras robo' ELSE 'Ataque elaborado' END
  || ' - Zona ' || (cluster % 2 + 1) || ' - ' || CASE cluster % 2 WHEN 0 THEN 'Half-space izquierdo' ELSE 'Carril central' END AS nm FROM m)
SELECT match_id, cluster, CASE WHEN count(*) OVER (PARTITION BY match_id, nm) > 1 THEN nm || ' - ' || CASE cluster % 2 WHEN 0 THEN 'Zona 1 - Inicio de campo propio (Half-space izquierdo)'
  ELSE 'Zona 2 - Zona media (Carril central)' END ELSE nm END AS pattern FROM b""")


def _report(s, d):
    q = seqs(s, d)
    totals = q.groupBy("match_id").agg(F.count("*").alias("sequences"), F.sum("shot").alias("shots_rival"), F.sum("goal").alias("shots_assigned"),
                                       F.sum("on_target").alias("shots_on_target_rival"))
    return reports.match_report_text(totals, ru.pattern_table(q))


put("report_text", _report, f"""
WITH s AS ({SEQ_SQL}), {_PATTERN},
t AS (SELECT match_id, count(*) AS n, sum(shot)::BIGINT AS a, sum(goal)::BIGINT AS b, sum(on_target)::BIGINT AS c FROM s GROUP BY 1),
k AS (SELECT p.*, main_cause FROM p JOIN mc USING (match_id, cluster) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY
  CASE WHEN (idd_mean + ipo_mean) / 2 <= 0.33 THEN 1 WHEN (idd_mean + ipo_mean) / 2 <= 0.66 THEN 2 ELSE 3 END DESC, ipo_mean DESC, cluster) = 1)
SELECT match_id, 'Partido ' || match_id || '.' || chr(10) || 'Se han detectado ' || n || ' secuencias ofensivas rivales.' || chr(10) || 'El rival registra ' || a || ' tiros oficiales, '
  || c || ' de ellos a puerta.' || chr(10) || b || ' tiros quedan asociados a secuencias analizadas; el resto quedan fuera por criterios de continuidad.' || chr(10)
  || 'El patron de mayor riesgo aparece en el cluster ' || cluster || ', con IDD medio ' || printf('%.2f', idd_mean) || ' e IPO medio ' || printf('%.2f', ipo_mean) || '.' || chr(10)
  || 'La causa principal dominante es ' || main_cause || '.' AS report FROM t JOIN k USING (match_id)""")


def _payload(s, d):
    p = reports.report_payload(plain(s, d))
    return reports.payload_text(p).join(p.select(
        "match_id", F.size("typologies").alias("n_typologies"), F.size("causes").alias("n_causes"), F.size("critical").alias("n_critical"),
        F.col("critical")[0]["seq_id"].alias("first_critical"), "most_dangerous", "high_threat"), "match_id").select(
        "match_id", "n_typologies", "n_causes", "n_critical", "first_critical", "most_dangerous", "high_threat")


put("report_payload", _payload, f"""
WITH s AS ({PLAIN_SQL}), y AS (SELECT match_id, typology, avg(ipo) AS m FROM s GROUP BY ALL)
SELECT s.match_id, count(DISTINCT typology)::INT AS n_typologies, count(DISTINCT cause)::INT AS n_causes, least(count(*), 8)::INT AS n_critical,
  arg_min(seq_id, (-score, seq_id)) AS first_critical, (SELECT arg_max(typology, m) FROM y WHERE y.match_id = s.match_id) AS most_dangerous,
  count(*) FILTER (WHERE ipo >= 0.6) AS high_threat FROM s GROUP BY 1""")
