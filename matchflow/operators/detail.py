"""The wide sequence table (one row per kept sequence) and its typed form for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import num, present
from ..functions.labels import typology_label
from ..schemas import PUBLISHED
from .indices import critical_score
from .rollups import VALIDATION_ALERT
from .timeline import match_minute

KEYS = ["match_id", "seq_id"]

# Columns published with three decimals, and texts read as true.
THREE_DECIMALS = ("idd", "ipo", "xt_max", "xt_gain", "xt_peak", "xt_sum", "xg", "finish_score", "duration_s", "start_s", "end_s")
TRUE_TEXTS = ("true", "1", "si", "sí", "yes")


def sequence_detail(indexed: DataFrame, seqs: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Index rows joined with geometry, validation, minute and score, in the published column set.

    All inputs hold one row per sequence; ordering (score, IPO descending) is left to the reader."""
    geometry = [c for c in seqs.columns if c not in indexed.columns]
    df = indexed.join(seqs.select(*KEYS, *geometry), KEYS, "left")
    if "start_s" not in df.columns:
        df = df.withColumns({"start_s": F.col("start_ms") / F.lit(1000.0), "end_s": F.col("end_ms") / F.lit(1000.0)})
    if validation is not None:
        df = df.join(validation, KEYS, "left")
        df = df.withColumn("rival_ok", F.coalesce("rival_ok", F.lit(False)))
    else:
        df = df.withColumn("rival_ok", F.lit(True))
    df = df.withColumn("alert", F.when(F.col("rival_ok"), F.lit("")).otherwise(F.lit(VALIDATION_ALERT)))
    n = num("cluster")
    short = F.when(n.isNull(), F.lit("-")).otherwise(F.concat(F.lit("T"), n.cast("int").cast("string")))
    df = match_minute(df.withColumn("typology", short), decimals=1)
    df = df.withColumns({"score": critical_score(), "xt_peak": F.col("xt_max"), "danger_behind": F.col("danger_rival_mean")})
    df = df.withColumns({c: F.round(c, 3) for c in present(df, THREE_DECIMALS)})
    return df.select("match_id", *present(df, PUBLISHED))


def detail_order() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("ipo").desc_nulls_last(), F.col("seq_id")]


# Numeric columns of the detail table when read back as text.
NUMERIC = ("idd", "ipo", "score", "xt_max", "xt_gain", "n_passes", "n_events", "n_rival_events", "minute", "duration_s", "shot", "on_target",
           "control_own_mean", "control_rival_mean", "danger_own_mean", "danger_rival_mean", "danger_behind", "control_lost", "danger_gained", "gap_ms")


def detail_types(df: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Numbers as numbers, goal texts as 0/1, typology labels; matches without detail come from ``fallback``."""
    if fallback is not None:
        rest = fallback.join(df.select("match_id").distinct(), "match_id", "left_anti")
        df = df.unionByName(rest, allowMissingColumns=True)
    df = df.withColumns({c: num(c) for c in present(df, NUMERIC)})
    if "goal" in df.columns:
        df = df.withColumn("goal", F.coalesce(F.lower(F.col("goal").cast("string")).isin(*TRUE_TEXTS), F.lit(False)).cast("int"))
    label = typology_label("cluster")
    return df.withColumn("typology", F.coalesce("typology", label) if "typology" in df.columns else label)
