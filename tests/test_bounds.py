"""No hidden limits: long intervals, fractional edges, rule parameters, labels, sequences without length."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchflow.functions.labels import typology_label
from matchflow.operators import align, intervals as iv, ordered as od, segment as sg
from matchflow.operators.ordered import Blocks

BLOCKS = Blocks.every(1 << 40)


def covering(spark, spans, points):
    intervals = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(spans)], "k long, seq long, low double, high double")
    rows = spark.createDataFrame([(0, p) for p in points], "k long, t long")
    out = iv.best_covering(rows, intervals, ["k"], "t", "low", "high", [F.col("seq")], ["seq"], BLOCKS)
    return {r["t"]: r["m_seq"] for r in out.collect()}


def test_very_long_interval(spark):
    top = 1 << 50
    assert covering(spark, [(0, top)], [5, 1 << 43, top - 5, top, top + 1]) == {5: 0, 1 << 43: 0, top - 5: 0, top: 0, top + 1: None}


def test_fractional_edges(spark):
    got = covering(spark, [(12345.6, 12999.4), (20000.2, 20000.8)], [12345, 12346, 12999, 13000, 20000, 20001])
    assert got == {12345: None, 12346: 0, 12999: 0, 13000: None, 20000: None, 20001: None}
    intervals = spark.createDataFrame([(0, 1, 12345.6, 12999.4)], "k long, seq long, low double, high double")
    points = spark.createDataFrame([(0, 12345), (0, 12400), (0, 13000)], "k long, t long")
    near = iv.nearest_interval(points, intervals, ["k"], "t", "low", "high", ["seq"], BLOCKS, tolerance=3500, tie="seq")
    assert {r["t"]: round(r["m_gap"], 6) for r in near.collect()} == {12345: 0.6, 12400: 0.0, 13000: 0.6}


def test_weights_limit_the_rows():
    align.AlignRules(rows_before=5, rows_after=6)
    for rules in ({"rows_before": 6}, {"rows_after": 7}, {"rows_before": -1}):
        with pytest.raises(ValueError):
            align.AlignRules(**rules)


def test_blocks_follow_rows(spark, monkeypatch):
    df = spark.range(5000)
    monkeypatch.setattr(od, "ROWS_PER_BLOCK", 50)
    assert 80 <= len(Blocks.equal_depth(df, "id").cuts) <= 100


def test_blocks_of_two_levels(spark, monkeypatch):
    """Few cuts and parts between them: as many blocks, in order, and the same running sums."""
    monkeypatch.setattr(od, "ROWS_PER_BLOCK", 50)
    monkeypatch.setattr(od, "MOST_CUTS", 8)
    df = spark.range(5000).select(F.lit(1).alias("k"), F.expr("CASE WHEN id < 2500 THEN id / 100 ELSE id * 3 END").cast("double").alias("t"))
    blocks = Blocks.equal_depth(df, "t")
    assert len(blocks.cuts) <= 9 and blocks.parts == 13
    marked = blocks.mark(df, "t").groupBy(od.BLOCK).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy(od.BLOCK).collect()
    assert 90 <= len(marked) <= 120 and max(r["n"] for r in marked) <= 400
    assert all(x["b"] < y["a"] for x, y in zip(marked, marked[1:]))
    out = od.ordered(df, ["k"], ["t"], blocks, running={"r": F.lit(1)}, lag={"p": F.col("t")}).orderBy("t").collect()
    assert [r["r"] for r in out] == list(range(1, 5001)) and [r["p"] for r in out] == [None, *(r["t"] for r in out[:-1])]


def test_most_centres(spark, monkeypatch):
    from matchflow.operators import cluster as cl
    monkeypatch.setattr(cl, "MOST_CENTRES", 3)
    centres = spark.range(4).select("id", F.array(F.col("id").cast("double")).alias("centre"), F.lit(1).alias("size"), F.lit(0.0).alias("mean_norm"))
    rows = spark.range(5).select(F.array(F.col("id").cast("double")).alias("v"))
    assert {r["assigned"] for r in cl.assign_nearest(rows, "v", centres.limit(3), "id").collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="more clusters than 3"):
        cl.assign_nearest(rows, "v", centres, "id").collect()


def test_linear_recurrence(spark, monkeypatch):
    """Blocks of a few positions, gaps, and a long axis: as a loop."""
    for decay, alpha, last in ((0.5, 0.8, 200), (30, 0.3, 300), (30, 0.999, 3000)):
        monkeypatch.setattr(od, "DECAY", decay)
        rows = [(k, i, float((i * 7 + k) % 5)) for k in (1, 2) for i in range(last) if (i + k) % 13]
        got = {(r["k"], r["i"]): r["v"] for r in od.decayed_sum(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], "i", F.col("x"), alpha, "v").collect()}
        held = {(k, i): x for k, i, x in rows}
        for k in (1, 2):
            v = 0.0
            for i in range(last):
                v = alpha * v + held.get((k, i), 0.0)
                if (k, i) in held:
                    assert got[k, i] == pytest.approx(v, rel=1e-11, abs=1e-12)


def test_chain_of_ten_thousand(spark):
    """Neighbours in time, each the predecessor of the next: rounds grow with the logarithm of the reach."""
    n, reach = 10_000, 8000.0
    seqs = spark.range(n).select(F.lit(1).alias("match_id"), F.lit(0).alias("period"), F.col("id").alias("cand_id"), (F.col("id") * 10.0).alias("start_ms"),
                                 (F.col("id") * 10.0 + 9).alias("end_ms"))
    rules = sg.SegmentRules(chain_gap_ms=5, chain_reach_ms=reach)
    wanted = seqs.where("cand_id % 2500 = 2499").select("match_id", "period", "cand_id")
    out = {r["cand_id"]: r for r in sg.chain_before(seqs, wanted, Blocks.every(1000), rules=rules).collect()}
    assert set(out) == {2499, 4999, 7499, 9999}
    for i, r in out.items():
        assert (r["chain_start"], r["n_added"]) == ((i - 800) * 10.0, 800)
        assert [m["cand_id"] for m in r["members"]] == list(range(i - 800, i))


def test_typology_label(spark):
    df = spark.createDataFrame([("T2",), ("0",), ("3.0",), ("Contraataque",), (None,), ("",), ("nan",)], "c string")
    assert [r[0] for r in df.select(typology_label("c")).collect()] == ["Tipología 3", "Tipología 1", "Tipología 4", "Contraataque", "-", "-", "-"]


def test_chain_passes_empty_sequences(spark):
    seqs = spark.createDataFrame([(1, 0, 1, 1000.0, 1000.0), (1, 0, 2, 1000.0, 5000.0), (1, 0, 3, 5200.0, 9000.0)],
                                 "match_id long, period long, cand_id long, start_ms double, end_ms double")
    out = sg.chain_before(seqs, seqs.select("match_id", "period", "cand_id"), Blocks.every(60_000))
    assert {r["cand_id"]: r["n_added"] for r in out.collect()} == {1: 0, 2: 0, 3: 1}
