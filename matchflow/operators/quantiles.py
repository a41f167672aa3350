"""Exact percentiles (linear interpolation) that never hold a group in one place.

A percentile is one or two wanted places in a group's sorted values. The open value range that holds a place is narrowed in rounds: a
sketch names some of its values as cuts, the rows on, between and beside the cuts are counted exactly, and the place falls either on a cut, whose
value is the answer, or between two of them. The sketch only chooses the cuts; whatever it says, the counts are exact and the next range holds the
place and fewer rows. Ranges of at most ``bound`` rows are sorted. A group of equal values is done after one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import num as finite
from ..lineage import cut

ACCURACY = 10_000
BOUND = 10_000
LATER_CUTS = 31


def _spans(ranges: DataFrame, at: list[str]) -> DataFrame:
    """The distinct ranges; several places may share one."""
    return ranges.select(*at, "__lo", "__hi").distinct()


def _inside(long: DataFrame, spans: DataFrame, at: list[str]) -> DataFrame:
    return long.join(spans, at).where((F.col("__v") > F.col("__lo")) & (F.col("__v") < F.col("__hi")))


def _narrowed(long: DataFrame, ranges: DataFrame, at: list[str], spots: list[float], accuracy: int) -> DataFrame:
    """The wanted places with the narrower range, or the value, that holds them."""
    span = [*at, "__lo", "__hi"]
    sketch = _inside(long, _spans(ranges, at), at).groupBy(*span).agg(
        F.sort_array(F.array_distinct(F.percentile_approx("__v", spots, accuracy))).alias("__cuts"))
    sketch = cut(sketch)
    # 0: below the first cut, 1: on it, 2: between it and the next, ...
    region = 2 * F.size(F.filter("__cuts", lambda c: c < F.col("__v"))) + F.array_contains("__cuts", F.col("__v")).cast("int")
    counts = _inside(long, sketch, at).groupBy(*span, region.alias("__r")).agg(F.count("*").alias("__k"))
    # one row per region of a range
    order = Window.partitionBy(*span).orderBy("__r")
    counts = counts.withColumn("__end", F.sum("__k").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(sketch, span)
    held = ranges.join(counts, span).where((F.col("__off") < F.col("__end")) & (F.col("__off") >= F.col("__end") - F.col("__k")))
    on, left = F.col("__r") % 2 == 1, F.floor(F.col("__r") / 2).cast("int")
    found = F.get("__cuts", left)
    return held.select(*at, "__i", "__n", F.when(on, found).alias("__value"),
                       F.when(on | (left == 0), F.col("__lo")).otherwise(F.get("__cuts", left - 1)).alias("__lo"),
                       F.when(on, F.col("__hi")).otherwise(F.coalesce(found, "__hi")).alias("__hi"),
                       (F.col("__off") - (F.col("__end") - F.col("__k"))).alias("__off"), F.col("__k").alias("__c"))


def percentile_table(df: DataFrame, keys: list[str], columns: list[str], probs: list[float],
                     accuracy: int = ACCURACY, bound: int = BOUND) -> DataFrame:
    """One row per key with ``{column}_p{permille}`` for every column and probability; NULL, NaN and infinite values are left out."""
    at = [*keys, "__m"]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), finite(c).alias("v"))
                                               for i, c in enumerate(columns)])).alias("__s"))
    long = cut(long.select(*keys, F.col("__s.m").alias("__m"), F.col("__s.v").cast("double").alias("__v")).where(F.col("__v").isNotNull()))
    rank = [f(F.lit(float(p)) * (F.col("__n") - 1)) for p in probs for f in (F.floor, F.ceil)]
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(rank)]))
    ranges = long.groupBy(*at).agg(F.count("*").alias("__n")).withColumn("__p", places).select(
        *at, F.col("__p.i").alias("__i"), "__n", F.lit(None).cast("double").alias("__value"), F.lit(float("-inf")).alias("__lo"),
        F.lit(float("inf")).alias("__hi"), F.col("__p.r").alias("__off"), F.col("__n").alias("__c"))
    eps = 4.0 / accuracy
    spots = sorted({min(max(p + e, 0.0), 1.0) for p in probs for e in (-eps, eps)})
    done = []
    while True:
        ranges = cut(ranges)
        wide = ranges.where(F.col("__value").isNull() & (F.col("__c") > bound))
        if wide.isEmpty():
            break
        done.append(ranges.where(F.col("__value").isNotNull() | (F.col("__c") <= bound)))
        ranges = _narrowed(long, wide, at, spots, accuracy)
        spots = [(k + 1) / (LATER_CUTS + 1) for k in range(LATER_CUTS)]
    for one in done:
        ranges = ranges.unionByName(one)
    few = ranges.where("__value IS NULL")
    span = [*at, "__lo", "__hi"]
    sorted_ = _inside(long, _spans(few, at), at).groupBy(*span).agg(F.sort_array(F.collect_list("__v")).alias("__vs"))
    read = few.join(sorted_, span).withColumn("__value", F.get("__vs", F.col("__off").cast("int"))).select(*at, "__i", "__n", "__value")
    every = read.unionByName(ranges.where("__value IS NOT NULL").select(*at, "__i", "__n", "__value")) if done else read

    def wanted(m: int, i: int):
        a, b = (F.max(F.when((F.col("__m") == m) & (F.col("__i") == 2 * i + k), F.col("__value"))) for k in (0, 1))
        place = F.lit(float(probs[i])) * (F.max(F.when(F.col("__m") == m, F.col("__n"))) - 1)
        return a + (b - a) * (place - F.floor(place))

    return every.groupBy(*keys).agg(*[wanted(m, i).alias(f"{c}_p{round(p * 1000)}") for m, c in enumerate(columns) for i, p in enumerate(probs)])


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row plus the columns of a one-row table, read once as a scalar subquery (no join)."""
    value = one.select(F.struct(*one.columns).alias("r")).scalar()
    return df.withColumn("__row", value).select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in one.columns])


def with_percentiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """Rows plus their group's percentiles (NULL for groups without a value); no keys means all rows."""
    table = percentile_table(df, keys, columns, probs)
    return df.join(table, keys, "left") if keys else attach_row(df, table)


def mode_table(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest on a tie; counted before it is compared."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__c"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("__c"), F.col(column))).alias(name))


def group_stats(df: DataFrame, keys: list[str], *aggs) -> DataFrame:
    """Rows plus aggregates of their group: aggregate first, then join the small result."""
    return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")
