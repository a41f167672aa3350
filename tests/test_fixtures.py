"""Hand-made cases with known answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from matchflow.functions import geometry, jsontext as jt, labels as lb
from matchflow.functions.xt import xt_surface
from matchflow.operators import align, cluster as cl, indices as ix, intervals as iv, rollups as ru, segment as sg, threat, timeline as tl, tracking as tr
from matchflow.operators.ordered import Blocks, ordered
from matchflow.operators.quantiles import percentile_table
from matchflow.operators.resample import resample

B = Blocks.every(1000)


def one(df, c=None):
    row = df.first()
    return row[c or df.columns[0]]


def values(df, *cols):
    rows = df.select(*cols).collect()
    return sorted([tuple(r) for r in rows], key=repr)


def test_downsample_first_non_null(spark):
    rows = [(1, 0, 7, float(t), i, None if i == 0 else 5, 0.1 * i, 0.5) for i, t in enumerate((0, 100, 249, 250))]
    df = spark.createDataFrame(rows, "match_id long, period int, player_id long, match_time double, frame long, team_id long, x double, y double")
    out = tr.downsample(df).orderBy("bucket").collect()
    assert [r.bucket for r in out] == [0, 1]
    assert (out[0].x, out[0].team_id, out[0].match_time) == (0.0, 5, 0)


def test_kinematics_caps_and_smooths(spark):
    df = spark.createDataFrame([(1, 0, 7, 0, 0, 0.0, 0.0), (1, 0, 7, 250, 1, 0.1, 0.0)],
                               "match_id int, period int, player_id int, match_time long, frame long, x double, y double")
    a, b = tr.player_kinematics(df).orderBy("frame").collect()
    assert a.speed is None and b.speed == 12 and b.dx_m == pytest.approx(10.2)
    assert a.speed_smooth == 12


def test_possession_rules(spark):
    rows = [(0.30, 9.0, 0.0, "none"), (1.9, 5.0, 5.0, "home"), (1.9, 5.0, 5.0, "neutral"), (2.1, 5.0, 5.0, "home")]
    df = spark.createDataFrame([(1, i, 0, 5, 1, d, s, b, st) for i, (d, s, b, st) in enumerate(rows)],
                               "match_id int, frame int, period int, player_id int, team_id int, ball_dist_m double, speed_smooth double, ball_speed double, ball_state string")
    assert [r.possessor for r in tr.detect_possession(df).orderBy("frame").collect()] == [1, 1, 2, 0]


def test_asof_nearest(spark):
    left = spark.createDataFrame([(1, 1000), (2, 1000)], "k int, t long")
    right = spark.createDataFrame([(1, 700, "a"), (1, 1300, "b"), (2, 599, "c")], "k int, u long, v string")
    out = iv.asof(left, right, ["k"], "t", "u", ["v"], B, direction="nearest", tolerance=400)
    assert values(out, "k", "m_v") == [(1, "a"), (2, None)]


@pytest.mark.parametrize("shot, want", [(800, (2, 0.0)), (5500, (2, 3500.0)), (5501, None)])
def test_nearest_interval(spark, shot, want):
    pts = spark.createDataFrame([(1, shot)], "k int, t long")
    seqs = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 500, 2000)], "k int, id int, a long, b long")
    r = iv.nearest_interval(pts, seqs, ["k"], "t", "a", "b", ["id"], B, tolerance=3500, tie="id").first()
    assert (r.m_id, r.m_gap) == (want or (None, None))


def test_tag_overlap(spark):
    pts = spark.createDataFrame([(1, t) for t in (49, 50, 100, 200, 300, 400, 500)], "k int, t long")
    seqs = spark.createDataFrame([(1, 1, 50, 250), (1, 2, 150, 400)], "k int, id int, a long, b long")
    out = iv.best_covering(pts, seqs, ["k"], "t", "a", "b", [F.col("id")], ["id"], B)
    assert values(out, "t", "m_id") == sorted([(49, None), (50, 1), (100, 1), (200, 2), (300, 2), (400, 2), (500, None)], key=repr)


def test_best_covering_against_brute_force(spark):
    rng = np.random.default_rng(7)
    iv_rows = [(int(k), i, int(a), int(a + d)) for i, (k, a, d) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 50_000, 300), rng.integers(0, 9000, 300)))]
    pt_rows = [(int(k), int(t)) for k, t in zip(rng.integers(0, 2, 400), rng.integers(0, 60_000, 400))]
    out = iv.best_covering(spark.createDataFrame(pt_rows, "k int, t long"), spark.createDataFrame(iv_rows, "k int, id int, a long, b long"),
                           ["k"], "t", "a", "b", [F.col("b") - F.col("a"), -F.col("id")], ["id"], B)

    def best(k, t):
        hits = [(b - a, -i) for kk, i, a, b in iv_rows if kk == k and a <= t <= b]
        return -max(hits)[1] if hits else None

    assert values(out, "k", "t", "m_id") == sorted([(k, t, best(k, t)) for k, t in pt_rows], key=repr)


def test_ordered_equals_plain_windows(spark):
    from pyspark.sql import Window
    rng = np.random.default_rng(3)
    rows = [(int(k), int(t), i, None if i % 4 else float(v)) for i, (k, t, v) in enumerate(zip(rng.integers(0, 2, 500), rng.integers(0, 20_000, 500), rng.random(500)))]
    df = spark.createDataFrame(rows, "k int, t long, i int, v double")
    out = ordered(df, ["k"], ["t", "i"], Blocks.equal_depth(df, "t", 9), lag={"a": F.col("v")}, lead={"b": F.col("i")}, last={"c": F.col("v")},
                  following={"d": F.col("v")}, running={"e": F.lit(1)})
    w = Window.partitionBy("k").orderBy("t", "i")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select("*", F.lag("v").over(w).alias("a"), F.lead("i").over(w).alias("b"), F.last("v", True).over(up).alias("c"),
                     F.first("v", True).over(down).alias("d"), F.sum(F.lit(1)).over(up).alias("e"))
    cols = ["k", "t", "i", "v", "a", "b", "c", "d", "e"]
    assert values(out, *cols) == values(want, *cols)


def test_percentiles_of_large_and_skewed_groups(spark):
    rng = np.random.default_rng(5)
    data = np.concatenate([np.repeat(3.0, 30_000), rng.normal(size=20_001)])
    df = spark.range(len(data)).select(F.lit("hot").alias("k"), F.col("id")).join(
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(data)], "id long, v double"), "id")
    df = df.unionByName(spark.createDataFrame([("cold", i, float(i)) for i in range(11)], "k string, id long, v double"))
    probs = [0.0, 0.013, 0.25, 0.5, 0.97, 1.0]
    got = {r.k: r for r in percentile_table(df, ["k"], ["v"], probs, accuracy=1000).collect()}
    for k, v in (("hot", data), ("cold", np.arange(11.0))):
        for p in probs:
            assert got[k][f"v_p{round(p * 1000)}"] == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_extend_possession(spark):
    rows = [(0, 9, 0.0), (3000, None, 1.0), (3600, None, 1.0)]
    df = spark.createDataFrame([(1, 0, i, t, p, s) for i, (t, p, s) in enumerate(rows)], "match_id int, period int, frame int, match_time long, possessing_team long, ball_speed double")
    assert [r.possession_reason for r in sg.extend_possession(df, B).orderBy("frame").collect()] == ["poseedor_claro", "balon_en_transito", "sin_control"]
    slow = spark.createDataFrame([(1, 0, 0, 0, 9, 0.0), (1, 0, 1, 2000, None, 0.1)], df.schema)
    assert sg.extend_possession(slow, B).orderBy("frame").collect()[1].possession_reason == "sin_control"


def test_possession_blocks(spark):
    rows = list(zip((0, 250, 500, 750, 5750), (False, True, True, False, True)))
    df = spark.createDataFrame([(1, 0, i, t, r) for i, (t, r) in enumerate(rows)], "match_id int, period int, frame int, match_time long, r boolean")
    assert [r.block_no for r in sg.possession_blocks(df, F.col("r"), B).orderBy("frame").collect()] == [1, 2, 2, 3, 4]


def test_chain_and_terminal(spark):
    seqs = spark.createDataFrame([(1, 0, "a", 0, 4000), (1, 0, "b", 6000, 9000), (1, 0, "c", 13_000, 18_000), (1, 0, "d", 30_000, 32_000)],
                                 "match_id int, period int, cand_id string, start_ms long, end_ms long")
    out = {r.cand_id: r.chain_start for r in sg.chain_before(seqs, seqs.select("match_id", "period", "cand_id"), B).collect()}
    assert out == {"a": 0, "b": 0, "c": 0, "d": 30_000}
    closers = spark.createDataFrame([(1, 0, 5000, "x"), (1, 0, 12_800, "y"), (1, 0, 35_500, "z")], "match_id int, period int, match_time long, close_reason string")
    got = {r.cand_id: (r.end_ms, r.close_reason) for r in sg.extend_to_terminal(seqs, closers, B).collect()}
    assert got == {"a": (5500, "x"), "b": (9000, "cierre_bepro"), "c": (18_000, "cierre_bepro"), "d": (35_500, "z")}


def test_resample_index(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((0, 10, 20))] + [(2, 0, 7.0)], "k int, t int, v double")
    out = {r.k: r.v for r in resample(df, ["k"], ["t"], {"v": F.col("v")}, 5, B, min_points=1).collect()}
    assert out == {1: [0, 5, 10, 15, 20], 2: [7] * 5}


def test_xt(spark):
    grid = xt_surface()
    assert grid.max() == pytest.approx(0.32) and np.allclose(grid, grid[:, ::-1])
    df = spark.createDataFrame([(102.0, 64.0), (0.0, 0.0), (51.0, 32.0)], "x double, y double")
    cells = df.select(geometry.grid_cell("x", 102, 32), geometry.grid_cell("y", 64, 24)).collect()
    assert [tuple(c) for c in cells] == [(31, 23), (0, 0), (16, 12)]


def test_finish_score(spark):
    base = dict(goal=False, shot=0, on_target=0, xg=None, cross=0, loss=0, x_end=50.0)
    cases = [(dict(goal=True), 1.0), (dict(shot=1, xg=0.05), 0.335), (dict(shot=1, xg=0.01), 0.307), (dict(shot=1, on_target=1), 0.75), (dict(shot=1), 0.60),
             (dict(cross=1), 0.30), (dict(loss=1, x_end=70.0), 0.20), (dict(loss=1, x_end=60.0), 0.10), ({}, 0.05)]
    df = spark.createDataFrame([Row(i=i, **{**base, **c}) for i, (c, _) in enumerate(cases)],
                               "i int, goal boolean, shot int, on_target int, xg double, `cross` int, loss int, x_end double")
    got = [r[0] for r in df.select(threat.finish_score(), "i").orderBy("i").collect()]
    assert got == pytest.approx([w for _, w in cases])


def test_percentile_scale(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(11)] + [(2, 4.0), (2, 4.0)], "k int, v double")
    out = {(r.k, r.v): r.s for r in ix.percentile_scale(df, ["k"], "v", 0.1, 0.9, "s").collect()}
    assert (out[1, 5.0], out[1, 0.0], out[1, 10.0], out[2, 4.0]) == (0.5, 0.0, 1.0, 0.0)


def test_momentum(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 0, 0.5)], "match_id int, m int, s double")
    assert one(tl.minute_signal(df, F.col("m"), F.col("s")), "signal") == pytest.approx(0.75)
    sig = spark.createDataFrame([(1, 0, 0.5)], "match_id int, minute long, signal double")
    ends = spark.createDataFrame([(1, 2)], "match_id int, last_minute long")
    assert [r.momentum for r in tl.decayed(sig, ends).orderBy("minute").collect()] == pytest.approx([0.1, 0.08, 0.064])


def test_bins_and_levels(spark):
    df = spark.createDataFrame([(15.0, 120.0)], "a double, b double")
    r = df.select(lb.minute_bin("a", True).alias("r"), lb.minute_bin("a", False).alias("l"), lb.minute_bin("b", True).alias("e"), lb.minute_bin("b", False).alias("o")).first()
    assert (r.r, r.l, r.e, r.o) == ("0-15", "16-30", "90+", None)
    risks = spark.createDataFrame([(v,) for v in (0.33, 0.331, 0.66, 0.661)], "v double").select(lb.risk_bin("v")).collect()
    assert [x[0] for x in risks] == ["bajo", "medio", "medio", "alto"]


def test_shot_text(spark):
    df = spark.createDataFrame([({"a": "Saved shot"},), ({"a": "goal", "b": "off target"},), ({"a": "post"},)], "p map<string,string>")
    assert [r[0] for r in df.select(jt.shot_on_target("p")).collect()] == [True, False, False]
    xg = spark.createDataFrame([({"xG": "bad", "my_xg": "0.4"},), ({"my_xg": "0.4"},), ({"z": "1"},)], "p map<string,string>")
    assert [r[0] for r in xg.select(jt.shot_xg("p")).collect()] == [None, 0.4, None]


def test_id_list(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("a, b ,",), ("",), (None,), ('{"a": 1}',), ("12",)], "t string")
    assert [r[0] for r in df.select(jt.id_list("t")).collect()] == [["a", "b"], ["a", "b"], [], [], [], []]


def test_pre_weights():
    assert align.pre_weights(4, False) == pytest.approx([0.4353, 0.6598, 0.8415, 1.0], abs=1e-4)
    assert align.pre_weights(2, True) == [0.85, 0.97]


def test_select_k(spark):
    # nine model sizes of a 273-row run: cost, silhouette, smallest cluster
    rows = [(2, 9043.06, .2769, 122), (3, 6866.20, .2701, 87), (4, 5939.60, .2307, 45), (5, 5405.27, .1966, 41), (6, 5049.73, .1687, 32), (7, 4723.28, .1816, 28),
            (8, 4516.42, .1725, 23), (9, 4350.99, .1594, 20), (10, 4237.52, .1452, 14)]
    diag = spark.createDataFrame(rows, "k int, inertia double, silhouette double, min_cluster_size long")
    assert one(cl.select_k(cl.elbow_strength(diag), 273).where("chosen"), "k") == 3


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x, lab = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    x += lab[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, lab))], "i int, v array<double>, c int")
    got = [r.silhouette for r in cl.silhouette(df, "v", "c", 3).orderBy("i").collect()]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = []
    for i in range(60):
        mean = [d[i, lab == c].sum() / ((lab == c).sum() - (c == lab[i])) for c in range(3)]
        a, b = mean[lab[i]], min(m for c, m in enumerate(mean) if c != lab[i])
        want.append((b - a) / max(a, b))
    assert got == pytest.approx(want)


def test_kmeans_pipeline_and_store(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(20, 4)), rng.normal(size=(20, 4)) + 8])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "i int, features array<double>")
    model, cost = cl.fit_pipeline(df, 2, restarts=3)
    z = (x - x.mean(0)) / x.std(0)
    want = sum(((z[s] - z[s].mean(0)) ** 2).sum() for s in (slice(0, 20), slice(20, 40)))
    assert cost == pytest.approx(want)
    cl.save_model(model, str(tmp_path / "m"))
    again = cl.apply_model(df, cl.load_model(str(tmp_path / "m"))).orderBy("i").collect()
    assert len({r.cluster for r in again[:20]}) == len({r.cluster for r in again[20:]}) == 1 and again[0].cluster != again[-1].cluster
    assert cl.load_model(str(tmp_path / "none")) is None
    diag = cl.kmeans_diagnostics(df, n_dims=4, k_min=2, k_max=3, restarts=2).collect()
    assert [d.k for d in diag] == [2, 3] and diag[0].inertia == pytest.approx(want) and diag[0].silhouette > diag[1].silhouette


def test_category_matrix_has_all_cells(spark):
    df = spark.createDataFrame([(1, "baja", "critica")], "match_id int, idd_category string, ipo_category string")
    rows = ru.category_matrix(df).collect()
    assert len(rows) == 5 and sum(sum(r[c] for c in lb.CATEGORIES) for r in rows) == 1


def test_attack_side_and_minimap(spark):
    from matchflow.operators import attack
    # no usable votes: the path that ends near x = 0 attacks to the left
    seqs = spark.createDataFrame([(1, 1, 0, None, None), (1, 2, 1, 90.0, 12.0)],
                                 "match_id int, seq_id int, period int, ball_x_m_end double, ball_x_norm_end double")
    pts = spark.createDataFrame([(1, 1, 0, i, 1000 * i, 40.0 - 9 * i, 32.0) for i in range(5)] + [(1, 2, 1, i, 1000 * i, 80.0 + i, 30.0) for i in range(2)],
                                "match_id int, seq_id int, period int, point_order int, match_time long, ball_x_m double, ball_y_m double")
    sides = attack.attack_side(seqs, pts)
    assert values(sides, "seq_id", "attacks_left") == [(1, True), (2, True)]
    index = tl.video_index(spark.createDataFrame([(1, "500", "0", None, None)], "match_id int, period0_padding_ms string, period0_start_ms string, "
                                                                               "period1_padding_ms string, period1_start_ms string"))
    rows = {r.seq_id: r for r in attack.minimap_points(pts, sides, index).collect()}
    assert [p.video_s for p in rows[1].points] == [0.5, 1.5, 2.5, 3.5, 4.5] and rows[2].points[1].video_s == 1.0
    assert rows[1].xt_max == rows[1].points[-1].xt > rows[1].points[0].xt and rows[1].xt_gain > 0
    assert rows[1].points[0].x_pct == pytest.approx(39.216)


def test_repair_text(spark):
    from matchflow.sources.textrepair import repair_columns
    good = ["Tipología de finalización", "plain", "¿qué?", "Transición"]
    bad = [good[0].encode().decode("latin1"), good[1], good[2].encode().decode("latin1").encode().decode("latin1"), good[3].encode().decode("cp1252")]
    df = repair_columns(spark.createDataFrame([(i, t) for i, t in enumerate([*bad, None, "Ây�"])], "i int, t string"))
    assert [r.t for r in df.orderBy("i").collect()] == [*good, None, "y"]


def test_repair_batches_are_bounded(spark, monkeypatch):
    """300 texts of 200 KB: 60 MB in one batch by rows alone."""
    from matchflow.sources import textrepair
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    largest = F.pandas_udf(lambda s: pd.Series([int(s.str.len().sum())] * len(s)), "long")
    monkeypatch.setattr(textrepair, "repair_text", largest)
    rows = spark.range(300).coalesce(1).select("id", F.repeat(F.lit("Ãx"), 100_000).alias("t"))
    try:
        got = textrepair.repair_columns(rows, ["t"]).agg(F.max("t"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert got[1] == 300 and got[0] <= textrepair.BATCH_BYTES


def test_catalogue_texts(spark):
    from matchflow.sources import catalogue as cat
    df = spark.createDataFrame([("C.D. Real de la Sierra Norte",), ("de la",), ("",)], "n string")
    assert [r[0] for r in df.select(cat.initials("n")).collect()] == ["CR", "DL", "R"]
