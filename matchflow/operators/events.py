"""Event feed: typed key events, official shots, goals and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as jt
from ..functions.expr import num, present
from .intervals import exists_within
from .ordered import Blocks

EVENT_BLOCKS = Blocks.every(300_000)

# Event types and set-piece types kept as key events; feed names of the columns.
KEY_TYPES = ("pass", "passreceived", "recovery", "interception", "ballrecovery", "clearance", "setpiece", "shot")
SETPIECE_TYPES = ("throwin", "freekick", "goalkick", "corner", "kickoff")
FEED_NAMES = {"period_order": "period", "event_time": "match_time", "id": "event_id"}
GOAL_OUTCOMES = ("goal", "shotgoal")


def typed_events(raw: DataFrame) -> DataFrame:
    """Lower-case headers, canonical names, numeric columns, parsed types; no row is dropped."""
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    df = df.withColumnsRenamed({k: v for k, v in FEED_NAMES.items() if k in df.columns})
    parsed = jt.parse_events("events")
    whole = present(df, ["match_id", "player_id", "team_id", "period"])
    casts = {c: num(c).cast("long") for c in whole}
    casts |= {c: num(c) for c in present(df, ["match_time", "x", "y", "to_x", "to_y"])}
    df = df.withColumns(casts)
    if "event_id" in df.columns:
        df = df.withColumn("event_id", F.col("event_id").cast("string"))
    return (df.withColumn("events_parsed", parsed).withColumn("event_types", jt.event_types("events_parsed"))
            .withColumn("setpiece_type", jt.setpiece_type("events_parsed"))
            .withColumn("event_text", F.lower(F.col("events"))))


def rescale_percent(df: DataFrame, columns, match_key: str = "match_id", limit: float = 1.5) -> DataFrame:
    """Columns whose largest value in a match exceeds ``limit`` are percentages: divide by 100."""
    cols = present(df, columns)
    top = df.groupBy(match_key).agg(*[F.max(c).alias(f"__max_{c}") for c in cols])
    out = df.join(top, match_key, "left")
    scaled = {c: F.when(F.col(f"__max_{c}") > limit, F.col(c) / F.lit(100.0)).otherwise(F.col(c)) for c in cols}
    return out.withColumns(scaled).drop(*[f"__max_{c}" for c in cols])


def is_key_event(types="event_types", setpiece="setpiece_type") -> Column:
    kinds = F.array(*[F.lit(t) for t in KEY_TYPES])
    known = F.coalesce(F.col(setpiece).isin(*SETPIECE_TYPES), F.lit(False))
    return F.arrays_overlap(F.col(types), kinds) & (~F.array_contains(types, "setpiece") | known)


def key_events(raw: DataFrame) -> DataFrame:
    """Events that matter for alignment and segmentation, coordinates in 0..1."""
    df = rescale_percent(typed_events(raw), ["x", "y", "to_x", "to_y"]).where(is_key_event())
    return df.dropna(subset=present(df, ["player_id", "x", "y", "period", "match_time"])).drop("events_parsed", "events")


def official_shots(raw: DataFrame, teams: DataFrame | None = None, blocks: Blocks = EVENT_BLOCKS,
                   window_ms: int = 1500) -> DataFrame:
    """Shots of the rival team (all teams when ``teams`` is None) with on-target, goal and xG.

    ``teams``: match_id, own_team, rival_team. A shot not on target becomes on target when a save
    of any team lies within the window in the same period."""
    df = typed_events(raw)
    shots = df.where(F.array_contains("event_types", "shot"))
    if teams is not None:
        shots = shots.join(teams, "match_id").where(F.when(F.col("rival_team").isNotNull(),
                                                           F.col("team_id") == F.col("rival_team"))
                                                    .otherwise(F.col("team_id") != F.col("own_team")))
        shots = shots.drop("own_team", "rival_team")
    prop = jt.event_property("events_parsed", "shot")
    shots = shots.withColumns({"shot_property": prop}).withColumns({
        "xg": jt.shot_xg("shot_property"), "shot": F.lit(1),
        "on_target": jt.shot_on_target("shot_property").cast("int"), "goal": jt.is_goal("shot_property")})
    saves = df.where(F.array_contains("event_types", "save")).select("match_id", "period", "match_time")
    out = exists_within(shots.drop("events_parsed"), saves, ["match_id", "period"], "match_time", "match_time", window_ms,
                        blocks, "__saved")
    return out.withColumn("on_target", F.greatest("on_target", F.col("__saved").cast("int"))).drop("__saved")


def infer_score(raw: DataFrame, sides: DataFrame) -> DataFrame:
    """Goals per match: shots with a goal outcome count for the team, own goals for the other one.

    ``sides``: match_id, home_team, away_team; events of other teams are left out."""
    df = typed_events(raw).join(sides, "match_id")
    known = df.where(F.col("team_id").isin(F.col("home_team"), F.col("away_team")))
    hit = known.select("match_id", "home_team", "away_team", "team_id", F.explode("events_parsed").alias("e"))
    kind = F.lower("e.event_type")
    outcome = F.lower(F.try_element_at("e.property", F.lit("outcome")))
    other = F.when(F.col("team_id") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    scorer = F.when((kind == "shot") & outcome.isin(*GOAL_OUTCOMES), F.col("team_id")).when(kind == "owngoal", other)
    goals = hit.withColumn("scorer", scorer).groupBy("match_id").agg(
        F.count_if(F.col("scorer") == F.col("home_team")).alias("home_goals"),
        F.count_if(F.col("scorer") == F.col("away_team")).alias("away_goals"))
    out = sides.join(goals, "match_id", "left").fillna(0, ["home_goals", "away_goals"])
    return out.withColumn("score", F.concat_ws(" - ", F.col("home_goals").cast("string"), F.col("away_goals").cast("string")))


def attack_direction(events: DataFrame, keys=("match_id", "period")) -> DataFrame:
    """Per period: does the team attack towards growing x? Mode of the stated direction is 'right'."""
    d = events.where(F.col("attack_direction").isNotNull())
    counts = d.groupBy(*keys, F.lower("attack_direction").alias("d")).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias("d"))
    return top.select(*keys, (F.col("d") == "right").alias("attacks_high"))


def mirror_by_direction(df: DataFrame, directions: DataFrame, columns: dict[str, tuple[str, float]],
                        keys=("match_id", "period")) -> DataFrame:
    """Adds attack-normalised columns: ``columns`` maps new name -> (source, size). A match without any
    known direction keeps period 0 and mirrors the rest; an unknown period of a known match is kept."""
    match_keys = list(keys)[:-1]
    known = directions.select(*match_keys).distinct().withColumn("__known", F.lit(True))
    out = df.join(directions, list(keys), "left").join(known, match_keys, "left")
    high = F.coalesce("attacks_high", F.when(F.col("__known"), F.lit(True)), F.col(list(keys)[-1]) == 0)
    new = {n: F.when(high, F.col(c)).otherwise(F.lit(float(size)) - F.col(c)) for n, (c, size) in columns.items()}
    return out.withColumns(new).drop("attacks_high", "__known")
