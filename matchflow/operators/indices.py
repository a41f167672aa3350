"""Scaling, categories and the two indices: IDD (defensive disorganisation) and IPO (offensive danger)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, mean_of, num
from ..functions.labels import CATEGORIES, CATEGORY_CUTS, INDEX_LEVELS, IPO_CUTS, classify_index
from .quantiles import attach_row, percentile_table, with_percentiles

# Sub-indices of IDD in tie order with weight, percentile range and published cause name,
# and sub-indices of IPO with weight and percentile range.
IDD_PARTS = (
    ("width_mean", 0.10, (0.10, 0.90), "estructura_anchura"),
    ("nearest_mean", 0.10, (0.10, 0.90), "presion_distancia"),
    ("retreat", 0.30, (0.10, 0.90), "estructura_retroceso"),
    ("control_rival_mean", 0.50, (0.05, 0.95), "pitch_control_rival"),
)
IPO_PARTS = (
    ("danger_rival_mean", 0.15, (0.10, 0.90)),
    ("xt_max", 0.35, (0.15, 0.85)),
    ("finish_score", 0.50, (0.10, 0.90)),
)
SCORE_WEIGHTS = {"ipo": 0.45, "idd": 0.35, "xt_max": 0.20}


def scaled(value, low, high) -> Column:
    """(value - low) / (high - low) clipped to 0..1; an empty or constant column gives 0."""
    v, lo, hi = num(value), F.col(low), F.col(high)
    flat = lo.isNull() | hi.isNull() | (lo == hi)
    return F.when(flat, F.lit(0.0)).otherwise(clip((v - lo) / (hi - lo), 0.0, 1.0))


def percentile_scale(df: DataFrame, keys: list[str], column: str, low: float, high: float, name: str) -> DataFrame:
    a, b = f"{column}_p{round(low * 1000)}", f"{column}_p{round(high * 1000)}"
    out = with_percentiles(df, keys, [column], [low, high])
    return out.withColumn(name, scaled(column, a, b)).drop(a, b)


def minmax_scale(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    ends = df.groupBy(*keys).agg(F.min(num(column)).alias("__lo"), F.max(num(column)).alias("__hi"))
    return df.join(ends, keys, "left").withColumn(name, scaled(column, "__lo", "__hi")).drop("__lo", "__hi")


def percentile_category(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Five ordered categories from the group's own percentiles; ``columns``: value -> new column. A NULL
    value stays NULL unless its whole group is NULL, which reads 'media'."""
    probs = list(CATEGORY_CUTS)
    out = with_percentiles(df, keys, list(columns), probs)
    new, extra = {}, []
    for value, name in columns.items():
        cuts = [f"{value}_p{round(p * 1000)}" for p in probs]
        extra += cuts
        v = num(value)
        rule = F.when(F.col(cuts[0]).isNull(), F.lit("media"))
        for cut, label in list(zip(cuts, CATEGORIES[1:]))[::-1]:
            rule = rule.when(v >= F.col(cut), F.lit(label))
        new[name] = rule.when(v.isNotNull(), F.lit(CATEGORIES[0]))
    return out.withColumns(new).drop(*extra)


def idd_inputs(profile: DataFrame) -> DataFrame:
    """Inputs of IDD from the profile arrays: mean width, mean nearest distance, retreat of the ball."""
    return profile.withColumns({
        "width_mean": mean_of("width"), "width_max": F.array_max("width"), "dist_mean": mean_of("dist"),
        "nearest_mean": mean_of("dist_nearest"),
        "retreat_raw": F.element_at("ball_x", -1) - F.element_at("ball_x", 1)}).withColumn(
        "retreat", clip("retreat_raw", 0.0))


def idd(df: DataFrame, keys: list[str], parts=IDD_PARTS) -> DataFrame:
    """Weighted sum of scaled sub-indices per group; the two largest sub-indices name the causes."""
    probs = sorted({p for _, _, ends, _ in parts for p in ends})
    out = with_percentiles(df, keys, [p[0] for p in parts], probs)
    subs = {f"sub_{c}": F.coalesce(scaled(c, f"{c}_p{round(lo * 1000)}", f"{c}_p{round(hi * 1000)}"), F.lit(0.0))
            for c, _, (lo, hi), _ in parts}
    out = out.withColumns(subs)
    total = sum((F.col(f"sub_{c}") * F.lit(w) for c, w, _, _ in parts[1:]), F.col(f"sub_{parts[0][0]}") * F.lit(parts[0][1]))
    order = F.sort_array(F.array(*[F.struct(F.col(f"sub_{c}").alias("v"), F.lit(-i).alias("i"), F.lit(name).alias("n"))
                                   for i, (c, _, _, name) in enumerate(parts)]), asc=False)
    out = out.withColumns({"idd": total, "cause": F.element_at(order, 1)["n"], "second_cause": F.element_at(order, 2)["n"]})
    return out.drop(*[f"{c}_p{round(p * 1000)}" for c, _, _, _ in parts for p in probs])


def ipo(df: DataFrame, keys: list[str], parts=IPO_PARTS) -> DataFrame:
    """Weighted sum of scaled sub-indices per group; a NULL input makes the index NULL."""
    probs = sorted({p for _, _, ends in parts for p in ends})
    out = with_percentiles(df, keys, [p[0] for p in parts], probs)
    out = out.withColumns({f"sub_{c}": scaled(c, f"{c}_p{round(lo * 1000)}", f"{c}_p{round(hi * 1000)}")
                           for c, _, (lo, hi) in parts})
    total = sum((F.col(f"sub_{c}") * F.lit(w) for c, w, _ in parts[1:]), F.col(f"sub_{parts[0][0]}") * F.lit(parts[0][1]))
    return out.withColumn("ipo", total).drop(*[f"{c}_p{round(p * 1000)}" for c, _, _ in parts for p in probs])


def critical_score() -> Column:
    """Score that orders sequences for review, 3 decimals; missing parts count as 0."""
    parts = [F.lit(w) * F.coalesce(num(c), F.lit(0.0)) for c, w in SCORE_WEIGHTS.items()]
    return F.round(parts[0] + parts[1] + parts[2], 3)


def index_reference(df: DataFrame, keys=()) -> DataFrame:
    """Per metric: three cuts and how many values fall in each of the four levels, over all rows (or per
    key). IDD cuts are p25/p50/p75 of the data, .25/.5/.75 without data; IPO cuts are fixed."""
    keys = list(keys)
    table = percentile_table(df, keys, ["idd"], [0.25, 0.50, 0.75])
    cut_columns = [F.coalesce(f"idd_p{round(q * 1000)}", F.lit(q)).alias(f"c{i}") for i, q in enumerate((0.25, 0.50, 0.75))]
    long = df.select(*keys, F.explode(F.array(
        F.struct(F.lit("idd").alias("metric"), num("idd").alias("v")),
        F.struct(F.lit("ipo").alias("metric"), num("ipo").alias("v")))).alias("s")).select(*keys, "s.*")
    both = long.join(table, keys, "left") if keys else attach_row(long, table)
    both = both.select(*keys, "metric", "v", *cut_columns)
    fixed = F.col("metric") == "ipo"
    cs = [F.when(fixed, F.lit(q)).otherwise(F.col(f"c{i}")) for i, q in enumerate(IPO_CUTS)]
    both = both.withColumns({"p25": cs[0], "p50": cs[1], "p75": cs[2]})
    v = F.col("v")
    return both.groupBy(*keys, "metric", "p25", "p50", "p75").agg(
        F.count("v").alias("n"), F.count_if(v < F.col("p25")).alias("level_1"),
        F.count_if((v >= F.col("p25")) & (v < F.col("p50"))).alias("level_2"),
        F.count_if((v >= F.col("p50")) & (v < F.col("p75"))).alias("level_3"),
        F.count_if(v >= F.col("p75")).alias("level_4")).withColumn(
        "method", F.when(F.col("metric") == "ipo", "manual").otherwise("percentiles"))


def classify_rows(df: DataFrame, reference: DataFrame, metric: str, name: str) -> DataFrame:
    """Rows with the level struct of one metric; ``reference`` is one row per metric (at most two rows)."""
    cuts = reference.where(F.col("metric") == metric).agg(F.max(F.struct("p25", "p50", "p75")).alias("__c"))
    out = attach_row(df, cuts)
    levels = classify_index(metric, [F.col("__c.p25"), F.col("__c.p50"), F.col("__c.p75")], INDEX_LEVELS[metric])
    return out.withColumn(name, levels).drop("__c")
