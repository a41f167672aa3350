"""Linear resampling of a per-group series to N points, without collecting the series.

Every row knows its own place and its successor's place on the target axis and emits only the
target points between the two, so a group of any length shrinks to N rows in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Blocks, ordered


def resample(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], n_points: int,
             blocks: Blocks, *, by: str = "index", min_points: int = 2) -> DataFrame:
    """One row per group: ``n_rows`` and an array of ``n_points`` numbers per value.

    ``by='index'`` spaces the rows evenly, ``by='time'`` uses ``order[0]`` as the axis (times must be
    distinct and not all equal). Groups with fewer than ``min_points`` rows are left out.
    """
    t = order[0]
    rows = df.select(*group, *order, *[e.cast("double").alias(f"__v_{n}") for n, e in values.items()])
    here = [f"__v_{n}" for n in values]
    axis = ordered(rows, group, order, blocks, lead={"__next": F.struct(F.col(t).alias("t"), *here)},
                   running={"__i": F.lit(1)})
    stats = rows.groupBy(*group).agg(F.count("*").alias("n_rows"), F.min(t).alias("__t0"), F.max(t).alias("__t1"))
    axis = axis.join(stats.where(F.col("n_rows") >= min_points), group)
    if by == "index":
        span, at, nxt = F.col("n_rows") - 1, F.col("__i") - 1, F.col("__i")
    else:
        axis = axis.where(F.col("__t1") > F.col("__t0"))
        span, at, nxt = F.col("__t1") - F.col("__t0"), F.col(t) - F.col("__t0"), F.col("__next.t") - F.col("__t0")
    last = n_points - 1
    single = F.col("n_rows") == 1
    a0 = F.when(single, F.lit(0.0)).otherwise(at * F.lit(last) / span)
    a1 = F.when(F.col("__next").isNotNull(), nxt * F.lit(last) / span)
    axis = axis.withColumn("__a0", a0.cast("double")).withColumn("__a1", a1.cast("double"))
    first = F.ceil("__a0")
    stop = F.when(F.col("__a1").isNotNull(), F.ceil("__a1") - 1).otherwise(F.lit(last))
    points = axis.withColumn("__j", F.explode(F.when(stop >= first, F.sequence(first, stop))))
    share = F.when(F.col("__a1").isNull() | (F.col("__j") == F.col("__a0")), F.lit(0.0)).otherwise(
        (F.col("__j") - F.col("__a0")) / (F.col("__a1") - F.col("__a0")))
    filled = [F.when(share == 0, F.col(v)).otherwise(F.col(v) + (F.col(f"__next.{v}") - F.col(v)) * share).alias(v)
              for v in here]
    packed = points.select(*group, "n_rows", "__j", *filled).groupBy(*group, "n_rows").agg(
        F.array_sort(F.collect_list(F.struct("__j", *here))).alias("__p"))
    return packed.select(*group, "n_rows", *[F.col(f"__p.__v_{n}").alias(n) for n in values])
