"""Exact percentiles against sorted lists, with ranges far smaller than the groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.operators import quantiles

PROBS = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]


def plain(values):
    return [float(np.quantile(np.array(values), p)) for p in PROBS]


def test_a_skewed_group_of_a_million(spark):
    """One group of 10^6 rows beside small ones; no more than 200 rows are ever sorted together."""
    n = 1_000_000
    df = spark.range(n + 60).select(F.when(F.col("id") < n, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"),
                                    ((F.col("id") * 48271) % 2147483647 / F.lit(1e6)).alias("a"),
                                    F.when(F.col("id") % 10 < 7, F.lit(3.5)).otherwise(F.exp((F.col("id") * 7919 % 1001) / F.lit(10.0))).alias("b"))
    got = {r["k"]: r for r in quantiles.percentile_table(df, ["k"], ["a", "b"], PROBS, bound=200).collect()}
    ids = np.arange(n + 60, dtype=np.int64)
    a = (ids * 48271 % 2147483647) / 1e6
    assert len(got) == 21
    for c in ("a", "b"):
        held = {r["k"]: r[c] for r in df.groupBy("k").agg(F.sort_array(F.collect_list(c)).alias(c)).collect()}
        for k, values in held.items():
            assert [got[k][f"{c}_p{round(p * 1000)}"] for p in PROBS] == pytest.approx(plain(values), rel=1e-12, abs=1e-12)
    assert got["hot"]["a_p500"] == pytest.approx(float(np.quantile(a[:n], 0.5)), rel=1e-12)


@pytest.mark.parametrize("bound", [1, 2, 5, 10_000])
@pytest.mark.parametrize("accuracy", [2, 10_000])
def test_cuts_only_guide(spark, bound, accuracy):
    """Coarse sketches and ranges of one row give the same numbers."""
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 150), rng.choice([-1.5, 0.0, 2.0, *rng.normal(0, 100, 40)], 150))]
    rows += [(0, None), (1, float("nan")), (2, float("inf")), (9, None), (7, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: [r[f"v_p{round(p * 1000)}"] for p in PROBS] for r in
           quantiles.percentile_table(df, ["k"], ["v"], PROBS, accuracy=accuracy, bound=bound).collect()}
    assert set(got) == {0, 1, 2, 7}
    for k in got:
        assert got[k] == pytest.approx(plain([v for g, v in rows if g == k and v is not None and np.isfinite(v)]), rel=1e-12, abs=1e-12)


def test_no_keys_and_no_rows(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"))
    assert [r.asDict() for r in quantiles.percentile_table(df, [], ["v"], [0.25]).collect()] == [{"v_p250": 2.5}]
    assert quantiles.percentile_table(df.where("false").withColumn("k", F.lit(1)), ["k"], ["v"], [0.5]).count() == 0
