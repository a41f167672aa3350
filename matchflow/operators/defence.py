"""Defensive shape and pitch control during a sequence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import distance, mean_of, present
from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH, mirror_fixed
from .ordered import Blocks
from .resample import resample
from .tracking import TRACKING_BLOCKS
from .trajectory import SEQ_KEYS

PROFILE = ("line", "width", "near5", "near10", "dist", "dist_nearest", "ball_x")
CONTROL = ("control_own", "control_rival", "danger_own", "danger_rival")


def defensive_frames(rows: DataFrame, keys=SEQ_KEYS, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Per (sequence, time): the defending team's line, width, players near the ball and ball distances.
    ``rows``: the own players' tracking rows inside sequences."""
    x, y = mirror_fixed("x_m", "period", length), mirror_fixed("y_m", "period", width)
    bx, by = mirror_fixed("ball_x_m", "period", length), mirror_fixed("ball_y_m", "period", width)
    tie = F.struct(*[F.col(c) for c in present(rows, ["frame", "player_id"])])
    df = rows.select(*keys, "match_time", x.alias("x"), y.alias("y"), bx.alias("bx"), tie.alias("tie"),
                     distance(x, y, bx, by).alias("d"))
    return df.groupBy(*keys, "match_time").agg(
        F.avg("x").alias("line"), (F.max("y") - F.min("y")).alias("width"), F.count_if(F.col("d") <= 5).alias("near5"),
        F.count_if(F.col("d") <= 10).alias("near10"), F.avg("d").alias("dist"), F.min("d").alias("dist_nearest"),
        F.min_by("bx", "tie").alias("ball_x"))


def defensive_profile(rows: DataFrame, blocks: Blocks = TRACKING_BLOCKS, keys=SEQ_KEYS, n_points: int = 20,
                      length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """The frame series of every sequence (two frames or more) resampled to ``n_points``."""
    frames = defensive_frames(rows, keys, length, width)
    return resample(frames, list(keys), ["match_time"], {c: F.col(c) for c in PROFILE}, n_points, blocks).drop("n_rows")


@dataclass(frozen=True)
class ControlRules:
    reaction_s: float = 0.7
    max_speed: float = 5.5
    steepness: float = 8.0
    grid_x: int = 30
    grid_y: int = 20
    min_players: int = 5
    min_frames: int = 3
    danger_x: float = 0.60
    danger_y: tuple = (0.15, 0.85)
    length: float = PITCH_LENGTH
    width: float = PITCH_WIDTH


CHUNK_FRAMES = 512


def _nearest(players: pa.ListArray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Squared distance from each grid point to the nearest player: (frames, x, y). Frames of as many players are worked out together, one
    player at a time, so memory is that of the result."""
    at = players.offsets.to_numpy()
    held = players.values
    px, py = (held.field(c).to_numpy(zero_copy_only=False) for c in ("px", "py"))
    many = np.diff(at)
    out = np.empty((len(many), len(xs), len(ys)))
    for n in np.unique(many).tolist():
        frames = np.flatnonzero(many == n)
        places = at[frames][:, None] + np.arange(n)
        across, along = (px[places][:, :, None] - xs) ** 2, (py[places][:, :, None] - ys) ** 2
        best = across[:, 0, :, None] + along[:, 0, None, :]
        for k in range(1, n):
            np.minimum(best, across[:, k, :, None] + along[:, k, None, :], out=best)
        out[frames] = best
    return out


def _control(rules: ControlRules, keys: list[str]):
    xs, ys = np.linspace(0, rules.length, rules.grid_x), np.linspace(0, rules.width, rules.grid_y)
    zone = np.outer(xs >= rules.length * rules.danger_x, (ys >= rules.width * rules.danger_y[0]) & (ys <= rules.width * rules.danger_y[1]))
    steep = rules.steepness / rules.max_speed

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_FRAMES):
                batch = whole.slice(start, CHUNK_FRAMES)
                mine, theirs = (_nearest(pa.concat_arrays([batch.column(c)]), xs, ys) for c in ("mine", "theirs"))
                p = 1 / (1 + np.exp(-steep * (np.sqrt(theirs) - np.sqrt(mine))))
                danger = pa.array(p[:, zone].mean(1)) if zone.any() else pa.nulls(len(p), pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(p.mean((1, 2))), danger], [*keys, "control_own", "danger_own"])
    return run


def control_frames(rows: DataFrame, own: Column, keys=SEQ_KEYS, rules: ControlRules = ControlRules()) -> DataFrame:
    """Pitch control per (sequence, time). The players of a frame (two teams) are gathered into one row, frames with too
    few players go, and the grid is worked out in Arrow batches of frames; no row is made per grid point."""
    keys = list(keys)
    second = F.when(F.col("period") == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    speed, angle = F.coalesce("speed_smooth", F.lit(0.0)), F.coalesce("direction", F.lit(0.0))
    x = mirror_fixed("x_m", "period", rules.length) + speed * F.cos(angle) * second * rules.reaction_s
    y = mirror_fixed("y_m", "period", rules.width) + speed * F.sin(angle) * second * rules.reaction_s
    # rows of an unknown team count as rival
    who = rows.select(*keys, "match_time", F.coalesce(own, F.lit(False)).alias("own"), F.struct(x.cast("double").alias("px"), y.cast("double").alias("py")).alias("at"))
    # rows without a place count as players and reach nothing
    placed = F.col("at.px").isNotNull() & F.col("at.py").isNotNull()
    frames = who.groupBy(*keys, "match_time").agg(
        F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_rival"),
        F.collect_list(F.when(F.col("own") & placed, F.col("at"))).alias("mine"),
        F.collect_list(F.when(~F.col("own") & placed, F.col("at"))).alias("theirs"))
    frames = frames.where((F.col("n_own") >= rules.min_players) & (F.col("n_rival") >= rules.min_players) & (F.size("mine") > 0) & (F.size("theirs") > 0))
    names = [*keys, "match_time"]
    schema = T.StructType([*frames.select(*names).schema, T.StructField("control_own", T.DoubleType()), T.StructField("danger_own", T.DoubleType())])
    shares = frames.select(*names, "mine", "theirs").mapInArrow(_control(rules, names), schema)
    return shares.select(*names, "control_own", (1 - F.col("control_own")).alias("control_rival"), "danger_own",
                         (1 - F.col("danger_own")).alias("danger_rival"))


def pitch_control(rows: DataFrame, own: Column, blocks: Blocks = TRACKING_BLOCKS, keys=SEQ_KEYS, n_points: int = 20,
                  rules: ControlRules = ControlRules()) -> DataFrame:
    """Control series of every sequence resampled to ``n_points``, with their summary."""
    frames = control_frames(rows, own, keys, rules)
    series = resample(frames, list(keys), ["match_time"], {c: F.col(c) for c in CONTROL}, n_points, blocks,
                      min_points=rules.min_frames).drop("n_rows")
    return control_summary(series)


def control_summary(df: DataFrame) -> DataFrame:
    """Means of the control series, own control lost and rival danger-zone control gained."""
    return df.withColumns({
        **{f"{c}_mean": mean_of(c) for c in CONTROL},
        "control_lost": F.element_at("control_own", 1) - F.element_at("control_own", -1),
        "danger_gained": F.element_at("danger_rival", -1) - F.element_at("danger_rival", 1)})
