"""Clustering of trajectories: scaling, k-means with restarts, choice of k, evaluation, model store."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from . import lloyd
from .quantiles import attach_row

FEATURES = ("verticality", "horizontality", "pass_rhythm", "duration_log", "events_log", "path_log", "mean_speed", "amplitude_m")


def model_frame(trajectories: DataFrame, features: DataFrame, keys=("match_id", "seq_id"), names=FEATURES,
                vector: str = "features") -> DataFrame:
    """Sequences that have both a trajectory and features, as one array; missing numbers count as 0."""
    def clean(v):
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)

    both = trajectories.join(features.select(*keys, *names), list(keys))
    values = F.concat("traj", F.array(*[F.col(n).cast("double") for n in names]))
    return both.select(*keys, F.transform(values, clean).alias(vector))


def column_moments(df: DataFrame, vector: str, n_dims: int) -> DataFrame:
    """One row: mean and population deviation of every dimension, in one aggregation."""
    dims = [F.col(vector)[i].cast("double") for i in range(n_dims)]
    return df.agg(F.array(*[F.avg(d) for d in dims]).alias("mean"), F.array(*[F.stddev_pop(d) for d in dims]).alias("std"))


def standardise(df: DataFrame, vector: str, n_dims: int, name: str = "scaled") -> DataFrame:
    """z-score with the population deviation; a constant dimension gives 0."""
    out = attach_row(df, column_moments(df, vector, n_dims))  # one row of 2 x n_dims numbers
    z = F.transform(F.arrays_zip(F.col(vector).cast("array<double>").alias("v"), "mean", "std"), lambda r: F.when(
        r["std"] > 0, (r["v"] - r["mean"]) / r["std"]).otherwise(F.lit(0.0)))
    return out.withColumn(name, z).drop("mean", "std")


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)


def centroids(df: DataFrame, vector: str, cluster: str, n_dims: int) -> DataFrame:
    """Mean vector, size and mean squared norm per cluster."""
    dims = [F.col(vector)[i].cast("double") for i in range(n_dims)]
    norm = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return df.groupBy(cluster).agg(F.array(*[F.avg(d) for d in dims]).alias("centre"), F.count("*").alias("size"),
                                   F.avg(norm).alias("mean_norm"))


def inertia(df: DataFrame, vector: str, cluster: str, n_dims: int) -> DataFrame:
    """Sum of squared distances to the own centre, per cluster: sum |x|^2 - n |centre|^2, one pass."""
    c = centroids(df, vector, cluster, n_dims)
    centre = F.aggregate("centre", F.lit(0.0), lambda a, v: a + v * v)
    return c.select(cluster, "size", (F.col("size") * (F.col("mean_norm") - centre)).alias("inertia"))


MOST_CENTRES = 10_000


def _packed(centres: DataFrame, cluster: str) -> DataFrame:
    """All centres in one row; k is a model parameter, and more than ``MOST_CENTRES`` of them are refused."""
    some = centres.limit(MOST_CENTRES + 1).agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "centre", "size", "mean_norm")).alias("__cs"))
    many = F.concat(F.lit("more clusters than "), F.lit(MOST_CENTRES).cast("string"))
    return some.select(F.when(F.size("__cs") > MOST_CENTRES, F.raise_error(many).cast(some.schema["__cs"].dataType)).otherwise(F.col("__cs")).alias("__cs"))


def assign_nearest(df: DataFrame, vector: str, centres: DataFrame, cluster: str, name: str = "assigned") -> DataFrame:
    """Nearest centre of every row, the smallest id on a tie, with its squared distance."""
    out = attach_row(df, _packed(centres, cluster))
    best = F.array_min(F.transform("__cs", lambda c: F.struct(squared_distance(F.col(vector), c["centre"]).alias("d"),
                                                              c["id"].alias("id"))))
    return out.withColumn("__b", best).withColumns({name: F.col("__b.id"), f"{name}_sq": F.col("__b.d")}).drop(
        "__b", "__cs")


def silhouette(df: DataFrame, vector: str, cluster: str, n_dims: int, name: str = "silhouette") -> DataFrame:
    """Silhouette of every row with squared Euclidean distance: exact and linear, because the mean squared
    distance to a cluster follows from its centre, size and mean squared norm."""
    out = attach_row(df, _packed(centroids(df, vector, cluster, n_dims), cluster))
    own_norm = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    out = out.withColumn("__n", own_norm)

    def mean_to(c):
        dot = F.aggregate(F.zip_with(F.col(vector), c["centre"], lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, v: a + v)
        return F.greatest(F.col("__n") - 2 * dot + c["mean_norm"], F.lit(0.0))

    dist = F.transform("__cs", lambda c: F.struct(c["id"].alias("id"), c["size"].alias("size"), mean_to(c).alias("d")))
    out = out.withColumn("__d", dist)
    mine = F.try_element_at(F.filter("__d", lambda c: c["id"] == F.col(cluster)), F.lit(1))
    a = mine["d"] * mine["size"] / F.when(mine["size"] > 1, mine["size"] - 1)
    b = F.array_min(F.transform(F.filter("__d", lambda c: c["id"] != F.col(cluster)), lambda c: c["d"]))
    out = out.withColumns({"__a": a, "__b": b})
    s = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.greatest("__a", "__b")), F.lit(0.0)))
    return out.withColumn(name, s).drop("__cs", "__n", "__d", "__a", "__b")


# ------------------------------------------------------------------------------------- k-means

# rows of a partition: fewer are not worth a task of their own, more are split whatever the number of cores
PART_ROWS = (1 << 12, 1 << 17)

def fit_pipeline(df: DataFrame, k: int, vector: str = "features", seed: int = 42, restarts: int = 20) -> tuple[PipelineModel, float]:
    """Scaling plus the best of ``restarts`` k-means fits (lowest cost); returns model and cost. All restarts share their passes."""
    stages, scaled, n = _scaling(df, vector)
    best, cost = _best_fit(scaled, k, n, seed, restarts)
    return PipelineModel([*stages, best]), cost


def _scaling(df: DataFrame, vector: str) -> tuple[list, DataFrame, int]:
    """(scaling stages, the scaled rows dealt for many passes, their number)."""
    rows = df.withColumn("__raw", array_to_vector(F.col(vector).cast("array<double>")))
    n = rows.count()
    scaler = StandardScaler(inputCol="__raw", outputCol="__z", withMean=True, withStd=True).fit(rows)
    factor = sqrt(n / (n - 1)) if n > 1 else 1.0  # sample deviation to population deviation
    stretch = ElementwiseProduct(scalingVec=[factor] * len(scaler.mean), inputCol="__z", outputCol="__scaled")
    scaled = stretch.transform(scaler.transform(rows)).select(vector_to_array("__scaled").alias("__scaled"))
    # a small file is one partition: dealt anew, a pass keeps all cores busy
    parts = max(min(-(-n // PART_ROWS[0]), df.sparkSession.sparkContext.defaultParallelism), -(-n // PART_ROWS[1]), 1)
    return [scaler, stretch], scaled.repartition(parts), n


def _best_fit(scaled: DataFrame, k: int, n: int, seed: int, restarts: int) -> tuple[KMeansModel, float]:
    blocks = lloyd.blocks_of(scaled, "__scaled")
    first = lloyd.starts(blocks, min(k, n), [seed + i for i in range(restarts)])
    best = min(lloyd.fit_blocks(blocks, first), key=lambda f: f.cost)
    blocks.unpersist()
    return _as_model(scaled.sparkSession, best.centres), float(best.cost)


def _as_model(spark: SparkSession, centres: np.ndarray) -> KMeansModel:
    """Spark's model with these centres: a fit on the centres themselves, all of which are drawn as starts, moves none."""
    apart = np.unique(centres, axis=0)
    rows = spark.createDataFrame([(Vectors.dense(c),) for c in apart], ["__scaled"])
    return KMeans(k=max(2, len(apart)), initMode="random", featuresCol="__scaled", predictionCol="cluster", maxIter=1).fit(rows)


def apply_model(df: DataFrame, model: PipelineModel, vector: str = "features", fill: float = 0.0) -> DataFrame:
    """Cluster of every row from a stored model; missing numbers count as ``fill``."""
    clean = F.transform(F.col(vector).cast("array<double>"), lambda v: F.coalesce(F.when(~F.isnan(v), v), F.lit(fill)))
    out = model.transform(df.withColumn("__raw", array_to_vector(clean)))
    return out.drop("__raw", "__z", "__scaled")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """Stored model, or None when there is none at the path."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:
        if "does not exist" in str(exc) or "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def kmeans_diagnostics(df: DataFrame, vector: str = "features", n_dims: int = 48, k_min: int = 2, k_max: int = 8,
                       seed: int = 42, restarts: int = 20) -> DataFrame:
    """Cost, silhouette (with squared Euclidean distance, so its best k can differ from that of the plain one) and smallest
    cluster for every k; fewer than four rows give an empty table. Rows are scaled and written once; the fits of all k and restarts share
    their passes."""
    spark = df.sparkSession
    schema = "k int, inertia double, silhouette double, min_cluster_size long"
    n = df.count()
    if n < 4:
        return spark.createDataFrame([], schema)
    scaled = cut(standardise(df, vector, n_dims).select("scaled"))
    ks = list(range(k_min, min(k_max, n - 1) + 1))
    sample = lloyd.sample_rows(scaled, "scaled")
    fits = lloyd.fit_many(scaled, "scaled", [lloyd.start(sample, k, seed + i) for k in ks for i in range(restarts)])
    best = [min(fits[j * restarts:(j + 1) * restarts], key=lambda f: f.cost) for j in range(len(ks))]
    means = lloyd.silhouettes(scaled, "scaled", best)
    rows = [(k, f.cost, s, int(f.sizes[f.sizes > 0].min())) for k, f, s in zip(ks, best, means)]
    return spark.createDataFrame(rows, schema)


def model_size(model: PipelineModel) -> int:
    """Number of clusters of a stored model."""
    return len(model.stages[-1].clusterCenters())


def elbow_strength(diag: DataFrame, keys=()) -> DataFrame:
    """Distance of (k, inertia) to the line through the first and last k; 0 with fewer than three rows.
    One row per k, so the table is tiny whatever the data."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = diag.withColumns({"__k1": F.min("k").over(whole), "__k2": F.max("k").over(whole), "__n": F.count("*").over(whole),
                          "__y1": F.min_by("inertia", "k").over(whole), "__y2": F.max_by("inertia", "k").over(whole)})
    dx, dy = F.col("__k2") - F.col("__k1"), F.col("__y2") - F.col("__y1")
    cross = F.abs(dx * (F.col("__y1") - F.col("inertia")) - dy * (F.col("__k1") - F.col("k")))
    norm = F.sqrt(dx * dx + dy * dy)
    value = F.when(F.col("__n") < 3, F.lit(0.0)).otherwise(cross / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
    return d.withColumn("elbow_strength", value).drop("__k1", "__k2", "__n", "__y1", "__y2")


def select_k(diag: DataFrame, n_rows, keys=(), share: float = 0.04) -> DataFrame:
    """Adds ``auto_score`` (.65 silhouette + .35 elbow, min-max scaled over the candidates) and ``chosen``.
    Candidates are the k whose smallest cluster is large enough; all k when none is. ``n_rows``: number of
    clustered rows, a number or a column."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    floor = F.greatest(F.lit(2), F.ceil(n * F.lit(share)))
    big = F.col("min_cluster_size") >= floor
    d = diag.withColumn("__big", big).withColumn("__any", F.max("__big").over(part))
    d = d.withColumn("__cand", F.col("__big") | ~F.col("__any"))

    def scaled(c):
        held = F.when(F.col("__cand"), F.coalesce(F.col(c), F.min(F.when(F.col("__cand"), F.col(c))).over(part)))
        lo, hi = F.min(held).over(part), F.max(held).over(part)
        return F.when(hi == lo, F.lit(0.0)).otherwise((held - lo) / (hi - lo))

    d = d.withColumns({"__s": F.coalesce("silhouette", F.min(F.when(F.col("__cand"), F.col("silhouette"))).over(part)),
                       "__e": F.col("elbow_strength")})
    score = F.lit(0.65) * scaled("__s") + F.lit(0.35) * scaled("__e")
    d = d.withColumn("auto_score", F.when(F.col("__cand"), score))
    order = part.orderBy(F.col("__cand").desc(), F.col("auto_score").desc_nulls_last(), F.col("silhouette").desc_nulls_last(),
                         F.col("k").asc())
    return d.withColumn("chosen", F.row_number().over(order) == 1).drop("__big", "__any", "__cand", "__s", "__e")


def cluster_sequences(df: DataFrame, n_clusters: int | None = None, vector: str = "features", n_dims: int = 48, seed: int = 42,
                      restarts: int = 20) -> DataFrame:
    """Cluster of every sequence; k given (at most the number of rows) or chosen from the diagnostics."""
    n = df.count()
    if n_clusters is None:
        diag = kmeans_diagnostics(df, vector, n_dims, seed=seed, restarts=restarts)
        best = select_k(elbow_strength(diag), n).where("chosen").select("k").first()
        n_clusters = best["k"] if best else 1
    k = min(n_clusters, n)
    if k <= 1:
        return df.withColumns({"cluster": F.lit(0), "n_clusters": F.lit(1)})
    model, _ = fit_pipeline(df, k, vector, seed, restarts)
    return apply_model(df, model, vector).withColumn("n_clusters", F.lit(k))


def pca_2d(df: DataFrame, vector: str, name: str = "pc") -> tuple[DataFrame, list[float]]:
    """First two principal components and their explained share in percent. Signs are arbitrary."""
    rows = df.withColumn("__v", array_to_vector(F.col(vector)))
    model = PCA(k=2, inputCol="__v", outputCol="__pc").fit(rows)
    pc = vector_to_array("__pc")
    out = model.transform(rows).withColumns({f"{name}1": pc[0], f"{name}2": pc[1]}).drop("__v", "__pc")
    return out, [float(v) * 100 for v in model.explainedVariance.toArray()]
