"""Catalogues, sets, joins and stage counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as cl, rollups as ru, tracking as tr
from ..sources import catalogue as cat
from .adapter import ORDERS_SQL, r6, sequences_of_orders, table

QUERIES, SQL = {}, {}


def put(name, fn, sql):
    QUERIES[name], SQL[name] = fn, sql


def _found_done(s, d):
    found = table(s, d, "orders").select(F.col("o_orderkey").alias("match_id"))
    done = table(s, d, "lineitem").select(F.col("l_orderkey").alias("match_id"))
    return found, done


put("pending_matches", lambda s, d: cat.pending_matches(*_found_done(s, d)),
    "SELECT o_orderkey AS match_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
put("new_vs_processed", lambda s, d: cat.pending_matches(*_found_done(s, d), limit=25),
    "SELECT o_orderkey AS match_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 25")


def _dedupe(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return tr.dedupe_rows(li, ("l_orderkey", "l_linenumber"), ("l_shipdate", "l_partkey", "l_suppkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey")


put("dedupe_first", _dedupe, """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""")


def _population(s, d):
    detail = table(s, d, "lineitem").selectExpr("l_orderkey AS match_id", "l_linenumber AS seq_id", "l_extendedprice AS idd", "l_quantity AS duration_s")
    ranking = table(s, d, "orders").selectExpr("o_orderkey AS match_id", "0 AS seq_id", "o_totalprice AS idd")
    return cat.load_population(detail, ranking)


put("union_population", _population, """SELECT l_orderkey AS match_id, l_linenumber AS seq_id, l_extendedprice AS idd, l_quantity AS duration_s FROM lineitem
UNION ALL SELECT o_orderkey, 0, o_totalprice, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")


def _names(s, d):
    rows = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").alias("team_id"), F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("CD de la "), F.replace("n_name", F.lit("_"), F.lit(" x")))).alias("team_name"))
    return cat.team_names(rows).withColumn("initials", cat.initials("team_name"))


put("team_names", _names, """
WITH t AS (SELECT DISTINCT n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN 'CD de la ' || replace(n_name, '_', ' x') END AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_nationkey AS team_id, coalesce(nm, n_nationkey::VARCHAR) AS team_name, CASE WHEN nm IS NULL THEN upper(substr(n_nationkey::VARCHAR, 1, 1)) ELSE 'NX' END AS initials FROM t""")


def _meta(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("match_id"), F.col("n_regionkey").alias("team_id"), F.col("n_name").alias("rival"), F.col("n_name").alias("team_name"),
        (F.col("c_custkey") % 90).alias("sequences"), F.round("c_acctbal", 2).alias("modified"))


def _context_rows(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("event_time"), F.when(
        F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("string")).alias("match_start_time"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("league"),
        F.when(F.col("o_orderkey") % 5 > 0, F.lit("FUTSAL")).alias("sport_type"), (F.col("o_orderkey") % 4).alias("season_id"))


put("match_context", lambda s, d: cat.match_context(_context_rows(s, d)), """
WITH f AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT o_custkey AS match_id, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'Fecha no disponible' END AS match_day,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CASE WHEN o_orderkey % 5 > 0 THEN 'FUTSAL' ELSE 'FOOTBALL' END || ' | temporada ' || (o_orderkey % 4) END AS competition FROM f""")


def _catalogue(s, d):
    scores = table(s, d, "orders").groupBy(F.col("o_custkey").alias("match_id")).agg(F.concat_ws(" - ", F.count_if(
        F.col("o_orderstatus") == "F").cast("string"), F.count_if(F.col("o_orderstatus") == "O").cast("string")).alias("score"))
    return cat.match_catalogue(_meta(s, d), cat.match_context(_context_rows(s, d)), scores)


put("match_catalogue", _catalogue, """
WITH f AS (SELECT o_custkey, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'Fecha no disponible' END AS day FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
g AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') || ' - ' || count(*) FILTER (WHERE o_orderstatus = 'O') AS score FROM orders GROUP BY 1)
SELECT c_custkey AS match_id, n_regionkey AS team_id, coalesce(day, 'Fecha no disponible') || ' | ' || n_name || ' | Partido ' || c_custkey AS label, n_name AS rival,
  coalesce(day, 'Fecha no disponible') AS match_day, coalesce(score, 'vs') AS score, c_custkey % 90 AS sequences, round(c_acctbal, 2) AS modified
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN g ON g.o_custkey = c_custkey""")
put("club_totals", lambda s, d: cat.club_totals(_meta(s, d)),
    """SELECT n_regionkey AS team_id, count(*) AS matches, sum(c_custkey % 90)::BIGINT AS sequences, max(round(c_acctbal, 2)) AS last_change
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")


def _registry(s, d):
    known = table(s, d, "region").select((F.col("r_regionkey") + 3).alias("team_id"), F.col("r_name").alias("team_name"))
    return cat.team_registry(_meta(s, d), known)


put("team_registry", _registry, """
WITH m AS (SELECT n_regionkey AS team_id, count(*) AS n, max(n_name) AS nm FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
k AS (SELECT r_regionkey + 3 AS team_id, r_name FROM region)
SELECT coalesce(m.team_id, k.team_id) AS team_id, coalesce(n, 0) AS matches, greatest(nm, r_name) AS team_name FROM m FULL JOIN k ON m.team_id = k.team_id""")


def _enrich(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(s, d, "nation")
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("o_orderkey", F.col("c_mktsegment").alias("cluster"), "n_name", r6("o_totalprice"))


put("enrich_joins", _enrich, """SELECT o_orderkey, c_mktsegment AS cluster, n_name, round(o_totalprice, 6) AS o_totalprice FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")


def _model_frame(s, d):
    traj = table(s, d, "embeddings").select(F.col("vec_id").alias("seq_id"), F.lit(0).alias("match_id"), F.col("embedding").cast("array<double>").alias("traj"))
    feats = table(s, d, "orders").selectExpr("o_orderkey AS seq_id", "0 AS match_id", "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1000 END AS a",
                                             "CASE WHEN o_orderkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END AS b")
    out = cl.model_frame(traj, feats, names=("a", "b"))
    return out.select("seq_id", F.posexplode("features").alias("i", "v")).select("seq_id", "i", r6("v"))


put("model_frame", _model_frame, """
WITH m AS (SELECT vec_id, list_concat(embedding::DOUBLE[], [CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1000 ELSE 0 END,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey::DOUBLE END]) AS f FROM embeddings JOIN orders ON o_orderkey = vec_id)
SELECT vec_id AS seq_id, i::INT AS i, round(f[i + 1], 6) AS v FROM m, range(66) r(i)""")


def _counts(s, d):
    o = sequences_of_orders(s, d)
    return ru.match_summary({"sequences": o, "shots": o.where("shot = 1"), "goals": o.where("goal = 1"), "late": o.where("minute > 119.8")})


put("resumen_counts", _counts, f"""SELECT match_id, count(*) AS sequences, count(*) FILTER (WHERE shot = 1) AS shots, count(*) FILTER (WHERE goal = 1) AS goals,
  count(*) FILTER (WHERE minute > 119.8) AS late FROM ({ORDERS_SQL}) GROUP BY 1""")
