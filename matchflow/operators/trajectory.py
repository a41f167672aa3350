"""Ball trajectories and tactical features of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import num, ratio
from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH, mirror_fixed
from .ordered import Blocks, ordered
from .resample import resample
from .tracking import TRACKING_BLOCKS

SEQ_KEYS = ("match_id", "seq_id")


def sequence_frames(tagged: DataFrame, keys=SEQ_KEYS, tie=("match_time", "player_id")) -> DataFrame:
    """One ball row per (sequence, period, frame) of the tagged tracking."""
    rows = tagged.where(F.col("seq_id").isNotNull())
    body = F.struct("match_time", "ball_x_m", "ball_y_m")
    return rows.groupBy(*keys, "period", "frame").agg(F.min_by(body, F.struct(*tie)).alias("b")).select(
        *keys, "period", "frame", "b.*")


def trajectories(ball: DataFrame, blocks: Blocks = TRACKING_BLOCKS, keys=SEQ_KEYS, n_points: int = 20,
                 length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Each sequence as ``n_points`` positions seen from the attack, interleaved x, y."""
    keys = list(keys)
    second = F.col("period") == 1
    places = {"x": F.when(second, F.lit(length) - F.col("ball_x_m")).otherwise(F.col("ball_x_m")),
              "y": F.when(second, F.lit(width) - F.col("ball_y_m")).otherwise(F.col("ball_y_m"))}
    out = resample(ball, keys, ["match_time", "frame"], places, n_points, blocks)
    return out.select(*keys, F.flatten(F.transform(F.arrays_zip("x", "y"), lambda p: F.array(p["x"], p["y"]))).alias("traj"))


def ball_amplitude(ball: DataFrame, keys=SEQ_KEYS) -> DataFrame:
    return ball.groupBy(*keys).agg((F.max("ball_y_m") - F.min("ball_y_m")).alias("amplitude_m"))


def tactical_features(seqs: DataFrame, amplitude: DataFrame | None = None, keys=SEQ_KEYS) -> DataFrame:
    """Eight features per sequence; missing or impossible ratios count as 0."""
    keys = list(keys)
    gain = F.col("ball_x_m_end") - F.col("ball_x_m_start")
    side = F.abs(F.col("ball_y_m_end") - F.col("ball_y_m_start"))
    df = seqs if amplitude is None else seqs.drop("amplitude_m").join(amplitude, keys, "left")
    amp = F.coalesce("amplitude_m", F.lit(0.0)) if "amplitude_m" in df.columns else F.lit(0.0)
    return df.select(
        *keys, ratio(gain, "path_m").alias("verticality"), ratio(side, "path_m").alias("horizontality"),
        ratio(F.coalesce("n_passes", F.lit(0)), "duration_s").alias("pass_rhythm"), F.log1p("duration_s").alias("duration_log"),
        F.log1p("n_rival_events").alias("events_log"), F.log1p("path_m").alias("path_log"),
        F.col("mean_speed"), amp.alias("amplitude_m"))


def thin_trajectory(ball: DataFrame, n_points: int = 24, blocks: Blocks = TRACKING_BLOCKS, keys=SEQ_KEYS,
                    order=("match_time", "frame")) -> DataFrame:
    """At most ``n_points`` rows per sequence, evenly spread over its rows; ``point_order`` from 0.

    Row ``r`` of ``n`` is kept when some i in 0..n_points-1 rounds (half to even) i*(n-1)/(n_points-1) to
    r; the rounded places are monotone, so the two neighbours of r decide."""
    keys = list(keys)
    numbered = ordered(ball, keys, list(order), blocks, running={"__r": F.lit(1)}, keep_block=True).withColumn(
        "__r", F.col("__r") - 1)
    sizes = ball.groupBy(*keys).agg(F.count("*").alias("__n"))
    step = (F.col("__n") - 1) / F.lit(n_points - 1)
    i0 = F.floor(F.col("__r") / step)
    places = F.transform(F.sequence(F.greatest(i0 - 1, F.lit(0)), F.least(i0 + 2, F.lit(n_points - 1))),
                         lambda i: F.bround(i.cast("double") * step, 0).cast("long"))
    kept = numbered.join(sizes, keys).where((F.col("__n") <= n_points) | F.array_contains(places, F.col("__r")))
    kept = kept.drop("__r", "__n")
    # at most n_points rows per sequence are left here
    w = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("point_order", (F.row_number().over(w) - 1).cast("long")).drop("__block")


def light_trajectories(tagged: DataFrame, clusters: DataFrame, n_points: int = 24, blocks: Blocks = TRACKING_BLOCKS,
                       keys=SEQ_KEYS) -> DataFrame:
    """Published light paths: thinned ball points with typology and shot flag."""
    ball = sequence_frames(tagged.where("ball_x_m IS NOT NULL AND ball_y_m IS NOT NULL"), keys)
    thin = thin_trajectory(ball, n_points, blocks, keys)
    n = num("cluster")
    label = F.when(n.isNull(), "-").otherwise(F.concat(F.lit("T"), n.cast("int").cast("string")))
    return thin.join(clusters.select(*keys, "cluster", "shot"), list(keys)).withColumn("typology", label)
