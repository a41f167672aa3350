"""Finish of each sequence, attack direction and the points of the clip mini-map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, flag
from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH
from ..functions.xt import xt_value
from .intervals import nearest_interval
from .ordered import Blocks
from .quantiles import percentile_table
from .timeline import video_time
from .tracking import TRACKING_BLOCKS

SEQ_KEYS = ["match_id", "seq_id"]


def assign_shots(shots: DataFrame, seqs: DataFrame, blocks: Blocks = TRACKING_BLOCKS, max_gap_ms: float = 3500,
                 keys=("match_id", "period")) -> DataFrame:
    """Each shot with the nearest sequence of its period, its gap and how it was assigned."""
    out = nearest_interval(shots, seqs.select(*keys, "seq_id", "start_ms", "end_ms"), list(keys), "match_time", "start_ms",
                           "end_ms", ["seq_id"], blocks, tolerance=max_gap_ms, tie="seq_id", prefix="__")
    how = F.when(F.col("__gap") == 0, "dentro_intervalo").when(F.col("__gap") > 0, "tiro_cercano_a_intervalo")
    return out.withColumn("assignment", how).withColumnsRenamed({"__seq_id": "seq_id", "__gap": "gap_ms"})


def attack_summary(tagged: DataFrame, seqs: DataFrame, assigned: DataFrame, clusters: DataFrame | None = None,
                   keys=SEQ_KEYS, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """One row per sequence with at least two ball rows: first and last ball, gain, amplitude, finish flags.
    Coordinates stay unmirrored, as in the published tables."""
    rows = tagged.where(F.col("seq_id").isNotNull())
    at = F.struct("match_time", "frame")
    known_x, known_y = F.when(F.col("ball_x_m").isNotNull(), at), F.when(F.col("ball_y_m").isNotNull(), at)
    path = rows.groupBy(*keys).agg(
        F.min_by("ball_x_m", known_x).alias("x_start"), F.max_by("ball_x_m", known_x).alias("x_end"),
        F.min_by("ball_y_m", known_y).alias("y_start"), F.max_by("ball_y_m", known_y).alias("y_end"),
        (F.max("ball_y_m") - F.min("ball_y_m")).alias("amplitude_m"), F.count("ball_x_m").alias("__n"))
    shots = assigned.where(F.col("seq_id").isNotNull()).groupBy(*keys).agg(
        F.max("on_target").alias("on_target"), F.max("goal").alias("goal"), F.min("match_time").alias("shot_ms"),
        F.min("gap_ms").alias("gap_ms"), F.min_by("assignment", "match_time").alias("assignment"), F.max("xg").alias("xg"))
    base = seqs if clusters is None else seqs.join(clusters.select(*keys, "cluster"), keys, "left")
    df = base.join(path.where("__n >= 2").drop("__n"), keys).join(shots, keys, "left")
    shot = F.col("shot_ms").isNotNull()
    return df.withColumns({
        "gain_x_m": F.col("x_end") - F.col("x_start"), "shot": shot.cast("int"), "on_target": flag("on_target"),
        "goal": F.coalesce(F.col("goal").cast("boolean"), F.lit(False)),
        "cross": ((F.col("x_end") > length * 0.75) & ((F.col("y_end") < 12) | (F.col("y_end") > width - 12))).cast("int"),
        "loss": ((F.col("x_end") < length * 0.5) & ~shot).cast("int")})


def direction_by_final_ball(seqs: DataFrame, keys=("match_id", "period"), x: str = "ball_x_m", shot: str = "shot",
                            length: float = PITCH_LENGTH) -> DataFrame:
    """Per period: do the sequences end in the high half? Shot sequences decide when there is one.
    ``seqs``: one row per sequence with its last ball x and the shot flag."""
    rows = seqs.withColumns({"__all": F.col(x), "__shot": F.when(flag(shot) == 1, F.col(x))})
    med = percentile_table(rows, list(keys), ["__all", "__shot"], [0.5])
    any_shot = rows.groupBy(*keys).agg(F.max(flag(shot)).alias("__any"))
    ref = F.when(F.col("__any") == 1, F.col("__shot_p500")).otherwise(F.col("__all_p500"))
    return any_shot.join(med, list(keys), "left").select(*keys, F.coalesce(ref >= length / 2, F.lit(False)).alias("attacks_high"))


def last_ball(tagged: DataFrame, keys=("match_id", "period", "seq_id")) -> DataFrame:
    return tagged.where(F.col("seq_id").isNotNull()).groupBy(*keys).agg(
        F.max_by("ball_x_m", F.struct("match_time", "frame")).alias("ball_x_m"))


def side_vote(raw: Column, norm: Column, length: float = PITCH_LENGTH) -> Column:
    """True when the normalised x mirrors the raw one (attack to the left), NULL when unclear."""
    r, n = clip(raw, 0, length), clip(norm, 0, length)
    right, left = F.abs(n - r), F.abs(n - (F.lit(length) - r))
    return F.when(F.abs(left - right) >= 1.0, left < right)


# Fixed values: (raw, normalised) column pairs that vote on the attack side.
VOTE_PAIRS = (("ball_x_m_end", "ball_x_norm_end"), ("ball_x_m_start", "ball_x_norm_start"), ("x_end", "ball_x_norm_end"))


def attack_side(seqs: DataFrame, points: DataFrame | None = None, keys=SEQ_KEYS, period=("match_id", "period"),
                length: float = PITCH_LENGTH) -> DataFrame:
    """Per sequence ``attacks_left``: majority of its own votes, else the period's share of clear votes,
    else the side on which its thinned path (``points``, at most 24 rows each) carries more threat."""
    pairs = [(a, b) for a, b in VOTE_PAIRS if a in seqs.columns and b in seqs.columns]
    votes = F.array_compact(F.array(*[side_vote(F.col(a), F.col(b), length) for a, b in pairs]))
    lefts = F.size(F.filter(votes, lambda v: v))
    own = F.when(F.size(votes) > 0, lefts > F.size(votes) / 2)
    rows = seqs.withColumns({"__own": own, "__vote": side_vote(F.col("ball_x_m_end"), F.col("ball_x_norm_end"), length)})
    share = rows.groupBy(*period).agg((F.avg(F.col("__vote").cast("int")) >= 0.5).alias("__period"))
    out = rows.join(share, list(period), "left")
    side = F.coalesce("__own", "__period")
    if points is not None:
        right, left = xt_value("ball_x_m", "ball_y_m", length=length), xt_value(F.lit(length) - F.col("ball_x_m"), "ball_y_m",
                                                                              length=length)
        order = F.struct("point_order", right.alias("r"), left.alias("l"))
        packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("p"))

        def strength(c):
            tail = F.slice("p", F.greatest(F.size("p") - 4, F.lit(1)), 5)
            mean = F.aggregate(F.transform(tail, lambda v: v[c]), F.lit(0.0), lambda a, v: a + v) / F.size(tail)
            return F.array_max(F.transform("p", lambda v: v[c])) + F.lit(1.35) * mean

        out = out.join(packed.select(*keys, (strength("l") > strength("r")).alias("__path")), keys, "left")
        side = F.coalesce(side, F.col("__path"))
    return out.select(*seqs.columns, side.alias("attacks_left"))


def minimap_points(points: DataFrame, sides: DataFrame, index: DataFrame, keys=SEQ_KEYS, length: float = PITCH_LENGTH,
                   width: float = PITCH_WIDTH) -> DataFrame:
    """Clip mini-map per sequence: its thinned path (at most 24 points) with video second, share of the
    pitch and xT seen from the attack side; also the largest xT and the gain along the path."""
    rows = points.join(sides.select(*keys, "attacks_left"), keys).withColumns({
        "x": clip("ball_x_m", 0, length), "y": clip("ball_y_m", 0, width), "match_s": F.col("match_time") / F.lit(1000.0)})
    rows = video_time(rows, index, "match_s", "video_s")
    xt = xt_value(F.when(F.col("attacks_left"), F.lit(length) - F.col("x")).otherwise(F.col("x")), "y", length=length, width=width)
    point = F.struct(
        "point_order", F.round("video_s", 3).alias("video_s"), F.round("match_s", 3).alias("match_s"), F.round("x", 3).alias("x"),
        F.round("y", 3).alias("y"), F.round(F.col("x") / length * 100, 3).alias("x_pct"),
        F.round(F.col("y") / width * 100, 3).alias("y_pct"), F.round(xt, 4).alias("xt"))
    out = rows.groupBy(*keys, "attacks_left").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return out.where(F.size("points") >= 2).withColumns({
        "xt_max": F.array_max(F.transform("points", lambda p: p["xt"])),
        "xt_gain": F.element_at("points", -1)["xt"] - F.element_at("points", 1)["xt"]})
