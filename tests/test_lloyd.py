"""k-means of many models at once against separate plain fits from the same starts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.operators import cluster as cl, lloyd


def plain_fit(x, c, tol=1e-4):
    for _ in range(300):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        still = ((new - c) ** 2).sum(1).max() <= tol * tol
        c = new
        if still:
            break
    far = ((x[:, None] - c) ** 2).sum(2)
    return c, far.min(1).sum(), np.bincount(far.argmin(1), minlength=len(c))


def plain_silhouette(x, label):
    far = ((x[:, None] - x) ** 2).sum(2)
    out = []
    for i in range(len(x)):
        mine = label == label[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = far[i, mine].sum() / (mine.sum() - 1)
        b = min(far[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(m, 1, (60, 3)) for m in ((0, 0, 0), (6, 0, 1), (0, 7, -2), (3, 3, 9))])


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame([(r.tolist(),) for r in points], "v array<double>").repartition(5).cache()


@pytest.mark.parametrize("group", [1 << 20, 20])
def test_costs_of_separate_fits(table, points, monkeypatch, group):
    monkeypatch.setattr(lloyd, "CENTRE_NUMBERS", group)
    sample = lloyd.sample_rows(table, "v")
    starts = [lloyd.start(sample, k, seed) for k in (2, 3, 4, 7) for seed in range(3)]
    fits = lloyd.fit_many(table, "v", starts)
    means = lloyd.silhouettes(table, "v", fits)
    for first, f, s in zip(starts, fits, means):
        centres, cost, sizes = plain_fit(points, first)
        assert np.allclose(f.centres, centres, atol=1e-8) and f.cost == pytest.approx(cost, rel=1e-9)
        assert f.sizes.tolist() == sizes.tolist()
        assert s == pytest.approx(plain_silhouette(points, ((points[:, None] - centres) ** 2).sum(2).argmin(1)), abs=1e-9)


def test_equal_rows(spark):
    """Fewer distinct rows than clusters: clusters without rows keep their centre and are left out of the counts."""
    table = spark.createDataFrame([([1.0, 1.0],)] * 6, "v array<double>")
    fit = lloyd.fit_many(table, "v", [lloyd.start(lloyd.sample_rows(table, "v"), 3, 0)])
    assert fit[0].cost == 0 and fit[0].sizes.sum() == 6 and lloyd.silhouettes(table, "v", fit) == [None]


def test_diagnostics(table):
    diag = cl.kmeans_diagnostics(table, "v", 3, 2, 6, restarts=4).orderBy("k").collect()
    assert [r["k"] for r in diag] == [2, 3, 4, 5, 6]
    assert all(a["inertia"] > b["inertia"] for a, b in zip(diag, diag[1:]))
    assert max(diag, key=lambda r: r["silhouette"])["k"] == 4 and diag[2]["min_cluster_size"] == 60
    model, cost = cl.fit_pipeline(table, 4, "v", restarts=4)
    assert cost == pytest.approx(diag[2]["inertia"], rel=1e-6) and cl.model_size(model) == 4
    assert cl.kmeans_diagnostics(table.limit(3), "v", 3).count() == 0


def test_global_clusters(spark):
    """The global model over two runs: diagnostics without k, a stored model and its clusters with k."""
    from matchflow.plans.season import global_clusters
    rng = np.random.default_rng(2)
    rows = [(m, s, (rng.normal(5 * (s % 2), 0.1, 40)).tolist()) for m in (1, 2) for s in range(12)]
    traj = spark.createDataFrame(rows, "match_id long, seq_id long, traj array<double>")
    feats = traj.select("match_id", "seq_id", *[F.lit(1.0).alias(n) for n in cl.FEATURES])
    parts = [(traj.where(F.col("match_id") == m), feats.where(F.col("match_id") == m)) for m in (1, 2)]
    frame, diag, model, assigned = global_clusters(parts, k_range=(2, 4), restarts=2)
    assert frame.count() == 24 and model is None and assigned is None
    best = diag.orderBy(F.col("silhouette").desc()).first()
    assert best["k"] == 2 and best["min_cluster_size"] == 12
    _, _, model, assigned = global_clusters(parts, k=2, k_range=(2, 4), restarts=2)
    assert cl.model_size(model) == 2
    kinds = {(r["seq_id"] % 2, r["cluster"], r["n_clusters"]) for r in assigned.collect()}
    assert len(kinds) == 2 and {n for *_, n in kinds} == {2}


def test_restarts_share_their_passes(spark, table, points):
    """Ten restarts run hardly more jobs than two, and the stored model holds the best of them."""
    sc, jobs = spark.sparkContext, []
    for restarts in (2, 10):
        sc.setJobGroup(f"restarts-{restarts}", "")
        model, cost = cl.fit_pipeline(table, 4, "v", restarts=restarts)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"restarts-{restarts}")))
    sc.setJobGroup("tests", "")
    assert jobs[1] < 2.5 * jobs[0]
    z = (points - points.mean(0)) / points.std(0)
    centres = np.array([c for c in model.stages[-1].clusterCenters()])
    assert len(centres) == 4 and ((z[:, None] - centres) ** 2).sum(2).min(1).sum() == pytest.approx(cost, rel=1e-9)
    assert cost == pytest.approx(min(plain_fit(z, lloyd.start(z, 4, s))[1] for s in range(10)), rel=1e-6)


def test_starts_of_all_rows(spark, table, points):
    """Starts are rows of the table that lie apart, the same however the rows are dealt; equal rows give one."""
    found = [lloyd.starts(lloyd.blocks_of(t, "v"), 4, [1, 2, 3]) for t in (table, table.repartition(2))]
    for a, b in zip(*found):
        assert np.array_equal(a, b) and len(np.unique(a, axis=0)) == 4 and all((points == r).all(1).any() for r in a)
    assert [len(s) for s in lloyd.starts(lloyd.blocks_of(spark.createDataFrame([([1.0, 1.0],)] * 6, "v array<double>"), "v"), 3, [0])] == [1]
