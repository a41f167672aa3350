"""Scaling, distances, silhouette, choice of k, k-means and projections on the embedding table."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import cluster as cl, rollups, threat
from .adapter import r6, table

QUERIES, SQL = {}, {}
DIMS = 64


def put(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def emb(spark, sf):
    return table(spark, sf, "embeddings")


LONG_SQL = "SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings"


def _standardise(spark, sf):
    out = cl.standardise(emb(spark, sf), "embedding", DIMS)
    return out.select("vec_id", F.posexplode("scaled").alias("i", "z")).select("vec_id", "i", r6("z"))


put("standardise", _standardise, f"""WITH e AS ({LONG_SQL})
SELECT vec_id, i::INT AS i, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS z FROM e WINDOW w AS (PARTITION BY i)""")

put("inertia", lambda s, d: cl.inertia(emb(s, d), "embedding", "label", DIMS).select("label", "size", r6("inertia")),
    f"""WITH e AS ({LONG_SQL}), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL)
SELECT e.label, count(DISTINCT vec_id) AS size, round(sum((v - m) * (v - m)), 6) AS inertia FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1""")

_DIST = f"""e AS ({LONG_SQL}), c AS (SELECT label AS cl, i, avg(v) AS m FROM e GROUP BY ALL),
s AS (SELECT vec_id, label, cl, sum((v - m) * (v - m)) AS d FROM e JOIN c ON e.i = c.i GROUP BY ALL)"""


def _assign(spark, sf):
    e = emb(spark, sf)
    out = cl.assign_nearest(e, "embedding", cl.centroids(e, "embedding", "label", DIMS), "label")
    return out.select("vec_id", "assigned", r6("assigned_sq"))


put("assign_nearest", _assign, f"WITH {_DIST} SELECT vec_id, arg_min(cl, (d, cl)) AS assigned, round(min(d), 6) AS assigned_sq FROM s GROUP BY 1")

put("silhouette", lambda s, d: cl.silhouette(emb(s, d), "embedding", "label", DIMS).select("vec_id", r6("silhouette")),
    f"""WITH {_DIST}, n AS (SELECT label AS cl, count(DISTINCT vec_id) AS n FROM e GROUP BY 1),
-- mean squared distance to a cluster = squared distance to its centre + mean squared spread of the cluster
sp AS (SELECT cl, avg(d) AS spread FROM s WHERE cl = label GROUP BY 1),
m AS (SELECT vec_id, label, s.cl, n, (d + spread) AS msd FROM s JOIN sp ON s.cl = sp.cl JOIN n ON n.cl = s.cl),
ab AS (SELECT vec_id, max(CASE WHEN cl = label AND n > 1 THEN msd * n / (n - 1) END) AS a, min(CASE WHEN cl <> label THEN msd END) AS b FROM m GROUP BY 1)
SELECT vec_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab""")


def _k_table(spark, sf):
    """Partitions of the orders by key remainder for k = 2..10: cost, smallest part and a quality figure."""
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k"), (F.col("o_totalprice") / 1000).alias("v"))
    parts = o.groupBy("k", (F.col("o_orderkey") % F.col("k") % (F.col("k") - F.col("k") % 3 + 1)).alias("c")).agg(
        F.count("*").alias("n"), F.var_pop("v").alias("s"), F.avg("v").alias("m"))
    return parts.groupBy("k").agg(F.round(F.sum(F.col("n") * F.col("s")), 3).alias("inertia"), F.round(F.stddev_pop("m"), 6).alias("silhouette"),
                                  F.min("n").alias("min_cluster_size"), F.sum("n").alias("n_rows"))


_K_SQL = """o AS (SELECT o_orderkey, k, o_totalprice / 1000 AS v FROM orders, range(2, 11) r(k)),
p AS (SELECT k, o_orderkey % k % (k - k % 3 + 1) AS c, count(*) AS n, var_pop(v) AS s, avg(v) AS m FROM o GROUP BY ALL),
d AS (SELECT k::INT AS k, round(sum(n * s), 3) AS inertia, round(stddev_pop(m), 6) AS silhouette, min(n) AS min_cluster_size, sum(n)::BIGINT AS n_rows FROM p GROUP BY 1),
b AS (SELECT *, min(k) OVER () AS k1, max(k) OVER () AS k2, arg_min(inertia, k) OVER () AS y1, arg_max(inertia, k) OVER () AS y2 FROM d),
e AS (SELECT *, abs((k2 - k1) * (y1 - inertia) - (y2 - y1) * (k1 - k)) / sqrt((k2 - k1)**2 + (y2 - y1)**2) AS elbow FROM b)"""

put("elbow_strength", lambda s, d: cl.elbow_strength(_k_table(s, d)).select("k", r6("inertia"), r6("elbow_strength")),
    f"WITH {_K_SQL} SELECT k, inertia, round(elbow, 6) AS elbow_strength FROM e")


def _select_k(spark, sf):
    out = cl.select_k(cl.elbow_strength(_k_table(spark, sf)), F.col("n_rows"), share=0.08)
    return out.select("k", "min_cluster_size", r6("auto_score"), F.col("chosen").cast("int").alias("chosen"))


put("select_k", _select_k, f"""WITH {_K_SQL},
f AS (SELECT *, min_cluster_size >= greatest(2, ceil(n_rows * 0.08::DOUBLE)) AS big, bool_or(min_cluster_size >= greatest(2, ceil(n_rows * 0.08::DOUBLE))) OVER () AS anyb FROM e),
g AS (SELECT *, big OR NOT anyb AS cand FROM f),
h AS (SELECT *, CASE WHEN cand THEN 0.65 * coalesce((silhouette - min(silhouette) FILTER (WHERE cand) OVER ()) / nullif(max(silhouette) FILTER (WHERE cand) OVER ()
  - min(silhouette) FILTER (WHERE cand) OVER (), 0), 0) + 0.35 * coalesce((elbow - min(elbow) FILTER (WHERE cand) OVER ()) / nullif(max(elbow) FILTER (WHERE cand) OVER ()
  - min(elbow) FILTER (WHERE cand) OVER (), 0), 0) END AS sc FROM g)
SELECT k, min_cluster_size, round(sc, 6) AS auto_score, (row_number() OVER (ORDER BY cand DESC, sc DESC NULLS LAST, silhouette DESC, k) = 1)::INT AS chosen FROM h""")

put("cluster_counts", lambda s, d: rollups.cluster_counts(emb(s, d), "label"),
    "SELECT label, count(*) AS sequences FROM embeddings GROUP BY 1")


def _mean_threat(spark, sf):
    e = emb(spark, sf).withColumn("match_id", F.col("vec_id") % 2)
    out = threat.threat_by_cluster(e, "label", column="embedding")
    return out.select("match_id", "label", "point", r6("mean_threat"))


put("threat_by_cluster", _mean_threat, """
WITH e AS (SELECT vec_id % 2 AS match_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT match_id, label, i, avg(v) AS m FROM e GROUP BY ALL)
SELECT match_id, label, i::INT AS point, round(avg(m) OVER (PARTITION BY match_id, label ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS mean_threat FROM m""")


def _kmeans(spark, sf):
    e = emb(spark, sf).select("vec_id", F.col("embedding").alias("features"))
    model, _ = cl.fit_pipeline(e, 10)
    return cl.apply_model(e, model).select("vec_id", "cluster")


put("kmeans_fit", _kmeans)


def _pca(spark, sf):
    e = cl.standardise(emb(spark, sf), "embedding", DIMS)
    points, _ = cl.pca_2d(e, "scaled")
    return points.groupBy("label").agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"), F.count("*").alias("n"))


put("pca_2d", _pca)


def _kmeans_facts(spark, sf):
    """What any k-means result must satisfy: every row placed, k clusters in use, every row at its nearest centre."""
    e = emb(spark, sf).select("vec_id", F.col("embedding").alias("features"))
    model, _ = cl.fit_pipeline(e, 10, restarts=2)
    placed = model.transform(e.withColumn("__raw", array_to_vector(F.col("features").cast("array<double>")))).select(
        "vec_id", "cluster", vector_to_array("__scaled").alias("scaled"))
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.stages[-1].clusterCenters())], "id int, centre array<double>")
    near = cl.assign_nearest(placed, "scaled", centres.withColumns({"size": F.lit(1), "mean_norm": F.lit(0.0)}), "id")
    far = F.try_element_at(F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.stages[-1].clusterCenters()]), F.col("cluster") + 1)
    gap = cl.squared_distance(F.col("scaled"), far) - F.col("assigned_sq")
    return near.agg(F.count("*").alias("n_rows"), F.count_distinct("cluster").alias("clusters"), F.count_if(gap > 1e-6).alias("not_nearest"))


put("kmeans_facts", _kmeans_facts, "SELECT count(*) AS n_rows, 10::BIGINT AS clusters, 0::BIGINT AS not_nearest FROM embeddings")


def _pca_facts(spark, sf):
    """Principal components of centred data: mean 0, no correlation, the first with the larger variance, never above the total."""
    e = cl.standardise(emb(spark, sf), "embedding", DIMS)
    points, shares = cl.pca_2d(e, "scaled")
    out = points.agg(F.count("*").alias("n_rows"), F.round(F.abs(F.avg("pc1")) + F.abs(F.avg("pc2")), 6).alias("mean"),
                     F.round(F.abs(F.corr("pc1", "pc2")), 6).alias("correlation"), (F.var_pop("pc1") >= F.var_pop("pc2")).cast("int").alias("ordered"),
                     F.round(F.abs(F.var_pop("pc1") - F.lit(shares[0] * DIMS / 100)), 3).alias("share_gap"))
    return out


put("pca_facts", _pca_facts, "SELECT count(*) AS n_rows, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS correlation, 1::INT AS ordered, 0.0::DOUBLE AS share_gap FROM embeddings")
