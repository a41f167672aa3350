"""Momentum, chronology windows and typology bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import MINUTE_LABELS
from ..operators import timeline as tl
from .adapter import DAY, TRACKING_SQL, r6, tracking
from .q_rollups import PLAIN_SQL, _LANE, _bin_sql, plain

QUERIES, SQL = {}, {}


def put(name, fn, sql):
    QUERIES[name], SQL[name] = fn, sql


def _noisy_or(spark, sf):
    t = tracking(spark, sf)
    day = F.floor(F.col("match_time") / DAY)
    signal = tl.minute_signal(t, day, F.col("value") / 500, ("player_id",))
    ends = t.groupBy("player_id").agg(F.max(day).alias("last_minute"))
    out = tl.decayed(signal, ends, ("player_id",))
    return out.select("player_id", F.col("minute").alias("day"), r6("signal"), r6("momentum"))


put("noisy_or_momentum", _noisy_or, f"""
WITH t AS (SELECT player_id, match_time // {DAY} AS d, value / 500 AS v FROM ({TRACKING_SQL})),
s AS (SELECT player_id, d, 1 - product(1 - v) AS s FROM t GROUP BY ALL), e AS (SELECT player_id, max(d) AS hi FROM t GROUP BY 1),
g AS (SELECT player_id, k AS d FROM e, range(40) r(k) WHERE k <= hi),
a AS (SELECT g.player_id, g.d, coalesce(s, 0) AS s FROM g LEFT JOIN s ON s.player_id = g.player_id AND s.d = g.d)
SELECT a.player_id, a.d::INT AS day, round(any_value(a.s), 6) AS signal, round(sum(0.2::DOUBLE * b.s * pow(0.8::DOUBLE, a.d - b.d)), 6) AS momentum
FROM a JOIN a b ON a.player_id = b.player_id AND b.d <= a.d GROUP BY a.player_id, a.d""")

# one match per customer keeps the noisy-OR signals off the ceiling
_KEY = "customer_id % 500 AS match_id"


def rows(spark, sf):
    return plain(spark, sf).drop("match_id").selectExpr("*", _KEY)


BASE_SQL = f"""o AS (SELECT * REPLACE ({_KEY.replace(' AS match_id', '')} AS match_id), {_LANE} AS lane FROM ({PLAIN_SQL})),
w AS (SELECT *, minute + greatest(duration_s, 2) / 60 AS end_minute, least(greatest(0.4::DOUBLE * idd + 0.6::DOUBLE * ipo, 0), 1) AS sg,
  (x_max >= 68)::INT AS lt, {_bin_sql('minute', False)} AS interval FROM o),
e AS (SELECT match_id, greatest(95, CAST(ceil(max(end_minute) + 2) AS BIGINT)) AS hi FROM w GROUP BY 1),
m0 AS (SELECT match_id, CAST(floor(minute) AS BIGINT) AS mi, 1 - product(1 - sg) AS s FROM w GROUP BY ALL),
g AS (SELECT match_id, k AS mi FROM e, range(140) r(k) WHERE k <= hi),
a AS (SELECT g.match_id, g.mi, coalesce(s, 0) AS s FROM g LEFT JOIN m0 ON m0.match_id = g.match_id AND m0.mi = g.mi),
tl AS (SELECT a.match_id, a.mi, any_value(a.s) AS signal, least(sum(0.2::DOUBLE * b.s * pow(0.8::DOUBLE, a.mi - b.mi)), 1) AS momentum
  FROM a JOIN a b ON a.match_id = b.match_id AND b.mi <= a.mi GROUP BY a.match_id, a.mi)"""

put("momentum_timeline", lambda s, d: tl.momentum_timeline(rows(s, d)).select("match_id", "minute", r6("signal"), r6("momentum")),
    f"WITH {BASE_SQL} SELECT match_id, mi::INT AS minute, round(signal, 6) AS signal, round(momentum, 6) AS momentum FROM tl")

WINDOWS_SQL = BASE_SQL + f""",
c AS (SELECT match_id, interval, count(*) AS n, avg(idd) AS i, avg(ipo) AS p, sum(shot) AS sh, sum(on_target) AS ot, sum(goal) AS gl, sum(lt) AS lt FROM w
  WHERE interval IS NOT NULL GROUP BY ALL),
t2 AS (SELECT *, {_bin_sql('mi', False)} AS interval FROM tl),
mm AS (SELECT match_id, interval, avg(momentum) AS mo, max(momentum) AS mx, quantile_cont(momentum, 0.9) AS p9 FROM t2 WHERE interval IS NOT NULL GROUP BY ALL),
fr AS (SELECT DISTINCT match_id, od AS interval_order, nm AS interval FROM o, (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(MINUTE_LABELS))}) v(od, nm)),
ww AS (SELECT fr.*, coalesce(n, 0) AS sequences, i, p, coalesce(sh, 0)::BIGINT AS shots, coalesce(ot, 0)::BIGINT AS ot, coalesce(gl, 0)::BIGINT AS gl, coalesce(lt, 0)::BIGINT AS lt, mo, mx, p9,
  round(least(0.6::DOUBLE * coalesce(p9, 0) + 0.4::DOUBLE * coalesce(mo, 0), 1), 9) AS stress
  FROM fr LEFT JOIN c ON c.match_id = fr.match_id AND c.interval = fr.interval LEFT JOIN mm ON mm.match_id = fr.match_id AND mm.interval = fr.interval)"""


def windows(spark, sf):
    out = tl.chronology_windows(tl.chronology_base(rows(spark, sf)))
    return out.withColumn("stress", F.round("stress", 9))


put("chronology_windows", lambda s, d: windows(s, d).select(
    "match_id", "interval_order", "interval", "sequences", r6("idd"), r6("ipo"), "shots", "shots_on_target", "goals", "last_third_entries", r6("momentum"),
    r6("momentum_max"), r6("momentum_p90"), r6("stress")),
    f"""WITH {WINDOWS_SQL} SELECT match_id, interval_order, interval, sequences, round(i, 6) AS idd, round(p, 6) AS ipo, shots, ot AS shots_on_target, gl AS goals,
  lt AS last_third_entries, round(mo, 6) AS momentum, round(mx, 6) AS momentum_max, round(p9, 6) AS momentum_p90, round(stress, 6) AS stress FROM ww""")

_SELECTED = """r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY stress DESC, interval_order) AS pl, count(*) OVER (PARTITION BY match_id) AS nw,
  row_number() OVER (PARTITION BY match_id ORDER BY shots DESC, stress DESC, interval_order) AS sp FROM ww WHERE sequences > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY (pl <= 2)::INT, stress, interval_order) AS cl FROM r),
se AS (SELECT *, 'critical' AS kind FROM q WHERE pl = 1 UNION ALL SELECT *, 'warning' FROM q WHERE pl = 2
  UNION ALL SELECT *, 'stable' FROM q WHERE cl = 1 AND nw > 2 UNION ALL SELECT *, 'most_shots' FROM q WHERE sp = 1)"""

put("select_windows", lambda s, d: tl.select_windows(windows(s, d)).select("match_id", "kind", "interval", r6("stress"), "shots", "phase"),
    f"""WITH {WINDOWS_SQL}, {_SELECTED} SELECT match_id, kind, interval, round(stress, 6) AS stress, shots, CASE WHEN stress >= 0.32 OR shots >= 2 THEN 'ESTRÉS ALTO'
  WHEN stress >= 0.20 OR lt >= 2 THEN 'ALERTA' ELSE 'CONTROLADO' END AS phase FROM se""")


def _card(spark, sf):
    base = tl.chronology_base(rows(spark, sf))
    out = tl.window_card(base, tl.select_windows(windows(spark, sf)))
    return out.select("match_id", "kind", "interval", "sequences", "shots", "last_third_entries",
                      F.round("idd_mean", 10).alias("idd_mean"), F.round("ipo_mean", 10).alias("ipo_mean"), "typology", "lane")


put("window_card", _card, f"""WITH {WINDOWS_SQL}, {_SELECTED},
pr AS (SELECT se.kind, w.* FROM w JOIN (SELECT match_id, interval, kind FROM se) se ON w.match_id = se.match_id AND w.interval = se.interval),
ty AS (SELECT match_id, kind, arg_min(typology, (-n, typology)) AS typology FROM (SELECT match_id, kind, typology, count(*) AS n FROM pr GROUP BY ALL) GROUP BY ALL),
ln AS (SELECT match_id, kind, arg_min(lane, (-n, lane)) AS lane FROM (SELECT match_id, kind, lane, count(*) AS n FROM pr GROUP BY ALL) GROUP BY ALL),
ag AS (SELECT match_id, kind, interval, count(*) AS sequences, sum(shot)::BIGINT AS shots, sum(lt)::BIGINT AS last_third_entries, round(avg(idd), 10) AS idd_mean, round(avg(ipo), 10) AS ipo_mean
  FROM pr GROUP BY ALL) SELECT * FROM ag JOIN ty USING (match_id, kind) JOIN ln USING (match_id, kind)""")

put("typology_timeline", lambda s, d: tl.typology_timeline(rows(s, d)).select("match_id", "seq_id", "typology", "start_minute", r6("end_minute"), r6("bar_minutes"), "finish"),
    f"""WITH {BASE_SQL} SELECT match_id, seq_id, typology, minute AS start_minute, round(end_minute, 6) AS end_minute, round(greatest(end_minute - minute, 0.05), 6) AS bar_minutes,
  CASE WHEN goal > 0 THEN 'goal' WHEN on_target > 0 THEN 'on_target' WHEN shot > 0 THEN 'shot' ELSE 'none' END AS finish FROM w""")


def _base(spark, sf):
    out = tl.chronology_base(rows(spark, sf))
    return out.select("match_id", "seq_id", r6("end_minute"), r6("xt_norm"), "last_third", r6("signal"), "lane")


put("chronology_base", _base, f"""WITH {BASE_SQL}, x AS (SELECT match_id, greatest(quantile_cont(xt_max, 0.9), 0.12) AS sc FROM w GROUP BY 1)
SELECT w.match_id, seq_id, round(end_minute, 6) AS end_minute, round(least(greatest(xt_max / sc, 0), 1), 6) AS xt_norm, lt AS last_third, round(sg, 6) AS signal, lane
FROM w JOIN x ON w.match_id = x.match_id""")
