"""Expected threat along a sequence, and how it finished."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, flag, num
from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH, mirror_fixed
from ..functions.xt import xt_value
from .ordered import Blocks
from .resample import resample
from .tracking import TRACKING_BLOCKS
from .trajectory import SEQ_KEYS

N_POINTS = 20


def sequence_threat(ball: DataFrame, blocks: Blocks = TRACKING_BLOCKS, keys=SEQ_KEYS, n_points: int = N_POINTS,
                    length: float = PITCH_LENGTH, width: float = PITCH_WIDTH, normalised: bool = False) -> DataFrame:
    """xT at ``n_points`` equal time steps of the ball path, and its start, end, gain, peak, sum and area.

    Points outside the pitch and frames without ball are left out; a sequence needs three distinct times."""
    keys = list(keys)
    x = F.col("ball_x_norm") if normalised else mirror_fixed("ball_x_m", "period", length)
    y = F.col("ball_y_norm") if normalised else mirror_fixed("ball_y_m", "period", width)
    inside = ball.select(*keys, "match_time", "frame", x.alias("x"), y.alias("y")).where(
        F.col("x").between(0, length) & F.col("y").between(0, width))
    single = inside.groupBy(*keys, "match_time").agg(F.min_by(F.struct("x", "y"), "frame").alias("p")).select(
        *keys, "match_time", "p.x", "p.y")
    path = resample(single, keys, ["match_time"], {"x": F.col("x"), "y": F.col("y")}, n_points, blocks, by="time",
                    min_points=3)
    xt = F.transform(F.arrays_zip("x", "y"), lambda p: xt_value(p["x"], p["y"], length=length, width=width))
    return threat_summary(path.select(*keys, xt.alias("threat")), n_points)


def threat_summary(df: DataFrame, n_points: int = N_POINTS) -> DataFrame:
    """Scalars of a threat series held in the array ``threat``."""
    t = F.col("threat")
    first, last = F.element_at(t, 1), F.element_at(t, -1)
    total = F.aggregate(t, F.lit(0.0), lambda a, v: a + v)
    area = (total - (first + last) / F.lit(2.0)) / F.lit(float(n_points - 1))
    return df.withColumns({
        "xt_start": first, "xt_end": last, "xt_gain": last - first, "xt_max": F.array_max(t), "xt_sum": total,
        "xt_area": area, "xt_peak_gain": F.array_max(t) - first})


def finish_score(length: float = PITCH_LENGTH) -> Column:
    """Score of how a sequence ended, from goal, shot, on_target, xg, cross, loss and x_end."""
    shot, xg = flag("shot") == 1, num("xg")
    by_xg = clip(F.lit(0.30) + F.lit(0.70) * xg, 0.30, 1.0)
    by_target = F.when(flag("on_target") == 1, F.lit(0.75)).otherwise(F.lit(0.60))
    lost = F.when(F.col("x_end") >= length * 0.66, F.lit(0.20)).otherwise(F.lit(0.10))
    return (F.when(F.coalesce(F.col("goal").cast("boolean"), F.lit(False)), F.lit(1.0))
            .when(shot, F.coalesce(by_xg, by_target)).when(flag("cross") == 1, F.lit(0.30))
            .when(flag("loss") == 1, lost).otherwise(F.lit(0.05)))


def threat_by_cluster(threat: DataFrame, cluster: str = "cluster", match_keys=("match_id",), column: str = "threat") -> DataFrame:
    """Mean threat per cluster and point, smoothed with a centred three-point mean."""
    keys = [*match_keys, cluster]
    mean = threat.select(*keys, F.posexplode(column).alias("point", "v")).groupBy(*keys, "point").agg(F.avg("v").alias("m"))
    w = Window.partitionBy(*keys).orderBy("point").rowsBetween(-1, 1)
    return mean.select(*keys, "point", F.avg("m").over(w).alias("mean_threat"))
