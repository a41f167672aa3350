"""Tracking: frames to rows, cleaning, time buckets, speeds, possession."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import distance, num, present
from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH, to_metres
from .ordered import Blocks, first_rows, ordered

TRACKING_BLOCKS = Blocks.every(60_000)  # one minute: frame rate x players rows per match at most

NUMERIC = ("match_time", "x", "y", "ball_x", "ball_y", "dist_ball")
WHOLE = ("match_id", "period", "frame", "player_id", "team_id", "possessor")


def coerce_numeric(df: DataFrame, columns, whole=()) -> DataFrame:
    """Text to number, bad text to NULL; ``whole`` columns become BIGINT."""
    casts = {c: num(c) for c in present(df, columns)}
    casts |= {c: num(c).cast("long") for c in present(df, whole)}
    return df.withColumns(casts)


def drop_incomplete(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=present(df, columns))


def flatten_frames(frames: DataFrame, lineup: DataFrame) -> DataFrame:
    """Nested frames to one row per player, with the first ball and the lineup's names.

    ``frames``: match_id, frame_index, match_time, period_order, ball_state, balls[], players[].
    ``player_pos`` keeps the order of the players inside their frame.
    """
    ball = F.try_element_at("balls", F.lit(1))
    rows = frames.select("match_id", F.col("frame_index").alias("frame"), "match_time",
                         F.col("period_order").alias("period"), "ball_state", ball["x"].alias("ball_x"),
                         ball["y"].alias("ball_y"), F.posexplode("players").alias("player_pos", "p"))
    rows = rows.select("*", F.col("p.player_id").cast("long").alias("player_id"), F.col("p.x").alias("x"),
                       F.col("p.y").alias("y")).drop("p")
    named = rows.join(lineup, ["match_id", "player_id"], "left")
    return named.withColumns({
        "player_name": F.coalesce("player_name", F.concat(F.lit("ID: "), F.col("player_id").cast("string"))),
        "dist_ball": distance("x", "y", "ball_x", "ball_y")})


def nearest_possessor(rows: DataFrame, own_team, frame_keys=("match_id", "period", "frame"),
                      threshold: float = 0.02, dist: str = "dist_ball", pos: str = "player_pos") -> DataFrame:
    """Marks the player nearest the ball in each frame when within ``threshold`` and names the
    frame's possession side. ``own_team``: team id as a column, or a literal."""
    keys = list(frame_keys)
    own = own_team if isinstance(own_team, Column) else F.lit(own_team)
    order = F.struct(F.col(dist).alias("dist"), F.col(pos).alias("pos"))
    near = rows.where(F.col(dist).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(dist).alias("dist"), "player_id", "team_id"), order).alias("__n"))
    near = near.where(F.col("__n.dist") <= threshold)
    out = rows.join(near, keys, "left")
    side = F.when(F.col("__n.team_id") == own, F.lit("propia")).when(F.col("__n.team_id").isNotNull(), F.lit("rival"))
    return out.withColumns({
        "possessor": F.coalesce((F.col("player_id") == F.col("__n.player_id")).cast("int"), F.lit(0)),
        "possession_side": side}).drop("__n")


def dedupe_rows(df: DataFrame, keys=("match_id", "period", "frame", "player_id"), order=("match_time",)) -> DataFrame:
    """First row per key in an explicit order."""
    return first_rows(df, list(keys), [F.col(c).asc_nulls_last() for c in order])


def downsample(df: DataFrame, bucket_ms: int = 250, keys=("match_id", "period", "player_id"), first=None,
               numeric=NUMERIC, required=("player_id", "period", "match_time", "x", "y")) -> DataFrame:
    """One row per key and time bucket; each column keeps its first non-null value in time order.

    Plain aggregation, so every map task shrinks its rows before the shuffle."""
    df = drop_incomplete(coerce_numeric(df, numeric, [c for c in WHOLE if c in df.columns]), required)
    keys = present(df, keys)
    columns = [c for c in (first or df.columns) if c not in keys]
    when = F.struct(F.col("match_time"), *[F.col(c) for c in present(df, ["frame"])])
    picks = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns]
    bucket = F.floor(F.col("match_time") / bucket_ms).cast("long").alias("bucket")
    return df.groupBy(*keys, bucket).agg(*picks)


def player_kinematics(df: DataFrame, blocks: Blocks = TRACKING_BLOCKS, keys=("match_id", "player_id", "period"),
                      length: float = PITCH_LENGTH, width: float = PITCH_WIDTH, max_speed: float = 12.0) -> DataFrame:
    """Positions in metres, step, speed (capped), direction, and the 3-row centred mean speed."""
    keys, order = present(df, keys), present(df, ["match_time", "frame"])
    here = {"x_m": to_metres("x", length), "y_m": to_metres("y", width)}
    moved = ordered(df.withColumns(here), keys, order, blocks, keep_block=True,
                    lag={"__p": F.struct("x_m", "y_m", "match_time")})
    dt = (F.col("match_time") - F.col("__p.match_time")) / F.lit(1000.0)
    moved = moved.withColumns({"dt_s": dt, "dx_m": F.col("x_m") - F.col("__p.x_m"),
                               "dy_m": F.col("y_m") - F.col("__p.y_m")})
    step = F.sqrt(F.col("dx_m") * F.col("dx_m") + F.col("dy_m") * F.col("dy_m"))
    raw = step / F.col("dt_s")
    moved = moved.withColumns({
        "step_m": step, "direction": F.atan2("dy_m", "dx_m"),
        "speed": F.when((F.col("dt_s") > 0) & raw.isNotNull(), F.least(raw, F.lit(float(max_speed))))}).drop("__p")
    both = ordered(moved, keys, order, blocks, lag={"__b": F.col("speed")}, lead={"__a": F.col("speed")})
    near = F.array_compact(F.array("__b", "speed", "__a"))
    total = F.coalesce("__b", F.lit(0.0)) + F.coalesce("speed", F.lit(0.0)) + F.coalesce("__a", F.lit(0.0))
    return both.withColumn("speed_smooth", F.try_divide(total, F.size(near))).drop("__a", "__b")


def ball_kinematics(df: DataFrame, blocks: Blocks = TRACKING_BLOCKS, frame_keys=("match_id", "period", "frame"),
                    length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Ball speed and direction per frame, joined back to the player rows, and player-ball distance."""
    keys = present(df, frame_keys)
    place = F.struct("match_time", F.col("ball_x"), F.col("ball_y"))
    tie = F.struct(*[F.col(c) for c in present(df, ["player_id"])] or [F.lit(0)])
    ball = df.groupBy(*keys).agg(F.min_by(place, tie).alias("b")).select(
        *keys, F.col("b.match_time").alias("match_time"), to_metres("b.ball_x", length).alias("ball_x_m"),
        to_metres("b.ball_y", width).alias("ball_y_m"))
    group = [k for k in keys if k != "frame"]
    moved = ordered(ball, group, ["match_time", "frame"], blocks,
                    lag={"__p": F.struct("ball_x_m", "ball_y_m", "match_time")})
    dx, dy = F.col("ball_x_m") - F.col("__p.ball_x_m"), F.col("ball_y_m") - F.col("__p.ball_y_m")
    dt = (F.col("match_time") - F.col("__p.match_time")) / F.lit(1000.0)
    ball = moved.select(*keys, "ball_x_m", "ball_y_m", F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / dt).alias("ball_speed"),
                        F.atan2(dy, dx).alias("ball_direction"))
    return attach_ball(df, ball, keys)


def attach_ball(df: DataFrame, ball: DataFrame, keys) -> DataFrame:
    """Ball features on every player row of the frame, plus player-ball distance in metres."""
    kept = df.drop(*[c for c in ball.columns if c not in keys])
    out = kept.join(ball, list(keys), "left")
    return out.withColumn("ball_dist_m", distance("x_m", "y_m", "ball_x_m", "ball_y_m"))


def assign_team_side(df: DataFrame, order=("period", "frame", "player_id"), match_key: str = "match_id") -> DataFrame:
    """Home = the team seen first in ``order``, away = the second; one row per (match, team)."""
    seen = df.where(F.col("team_id").isNotNull()).groupBy(match_key, "team_id").agg(
        F.min(F.struct(*[F.col(c) for c in order])).alias("__first"))
    # one row per team of a match: the window runs on the aggregated table
    place = F.row_number().over(Window.partitionBy(match_key).orderBy("__first", "team_id"))
    side = F.when(place == 1, F.lit("home")).when(place == 2, F.lit("away"))
    return seen.select(match_key, "team_id", side.alias("team_side"))


@dataclass(frozen=True)
class PossessionRules:
    candidate_m: float = 2.0
    clear_m: float = 0.30
    max_speed_gap: float = 5.0


def detect_possession(df: DataFrame, sides: DataFrame | None = None, rules: PossessionRules = PossessionRules(),
                      match_key: str = "match_id") -> DataFrame:
    """1 = clear or state-confirmed possessor, 2 = candidate in a neutral state, 0 = none."""
    sides = assign_team_side(df, match_key=match_key) if sides is None else sides
    out = df.drop("team_side").join(sides, [match_key, "team_id"], "left")
    state = F.coalesce(F.col("ball_state"), F.lit("none")) if "ball_state" in df.columns else F.lit("neutral")

    def speed(names):
        found = present(df, names)
        return F.coalesce(F.col(found[0]), F.lit(0.0)) if found else F.lit(0.0)

    gap = F.abs(speed(["speed_smooth", "speed"]) - speed(["ball_speed"]))
    near = (F.col("ball_dist_m") <= rules.candidate_m) & (gap <= rules.max_speed_gap)
    confirmed = (F.col("team_side") == state) & (state != "none")
    rule = (F.when(F.col("ball_dist_m") <= rules.clear_m, 1).when(near & confirmed, 1)
            .when(near & (state == "neutral"), 2).otherwise(0))
    return out.withColumn("possessor", rule)


def own_and_rival(df: DataFrame, match_key: str = "match_id", own_team: int | None = None) -> DataFrame:
    """Own team = the given one, else the team with most rows (smallest id on a tie); rival = the
    other team seen first."""
    counts = df.where(F.col("team_id").isNotNull()).groupBy(match_key, "team_id").agg(
        F.count("*").alias("n"), F.min(F.struct(*[F.col(c) for c in present(
            df, ["period", "frame", "player_id"])], F.col("team_id"))).alias("first"))
    if own_team is None:
        own = counts.groupBy(match_key).agg(F.min_by("team_id", F.struct(-F.col("n"), F.col("team_id"))).alias("own_team"))
    else:
        own = counts.select(match_key).distinct().withColumn("own_team", F.lit(own_team))
    rest = counts.join(own, match_key).where(F.col("team_id") != F.col("own_team"))
    rival = rest.groupBy(match_key).agg(F.min_by("team_id", "first").alias("rival_team"))
    return own.join(rival, match_key, "left")


def frame_table(df: DataFrame, keys=("match_id", "period", "frame"), tie: str = "player_id") -> DataFrame:
    """One row per frame: time, ball place and speed (first non-null), first possessing team."""
    order = F.struct("match_time", tie)

    def first(c):
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)

    team = F.min_by("team_id", F.when((F.col("possessor") == 1) & F.col("team_id").isNotNull(), order))
    speed = [first("ball_speed")] if "ball_speed" in df.columns else [F.lit(0.0).alias("ball_speed")]
    return df.groupBy(*keys).agg(F.min("match_time").alias("match_time"), first("ball_x_m"), first("ball_y_m"), *speed,
                                 team.alias("possessing_team"))
