"""What is known about matches and teams: names, pseudonyms, contexts, catalogues, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, present
from ..operators.ordered import first_rows
from ..operators.quantiles import attach_row

# Words left out of a team's initials, and columns that may name the competition.
STOP_WORDS = ("cd", "cf", "ad", "a", "d", "de", "la", "el")
COMPETITION_COLUMNS = ("competition_name", "competition", "league_name", "league", "tournament_name")
NO_DATE = "Fecha no disponible"


def normalise_matches(raw: DataFrame, json: str = "raw") -> DataFrame:
    """Match-list JSON text to one row per match: id, date and team names with fall-backs, raw text."""
    def get(*paths):
        return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{p}"), F.lit("")) for p in paths])

    out = raw.select(
        get("id", "match_id").try_cast("long").alias("match_id"),
        get("match_date", "date", "start_time", "match_start_time").alias("match_date"),
        get("home_team.name", "home_team.team_name", "home_team_name").alias("home_team"),
        get("away_team.name", "away_team.team_name", "away_team_name").alias("away_team"), F.col(json).alias("raw"))
    return first_rows(out.where("match_id IS NOT NULL"), ["match_id"], [F.col("raw").asc()])


def lineup_dim(raw: DataFrame, json: str = "raw") -> DataFrame:
    """Lineup JSON (one text per match) to player rows with display name and team."""
    schema = ("struct<data:array<struct<lineup:array<struct<player_id:string,player_full_name:string,player_name:string,"
              "team_id:long,team_full_name:string,team_name:string>>>>>")
    first = F.try_element_at(F.from_json(json, schema)["data"], F.lit(1))
    p = raw.select("match_id", F.explode(first["lineup"]).alias("p"))
    rows = p.select(
        "match_id", F.col("p.player_id").try_cast("long").alias("player_id"),
        F.coalesce(F.nullif("p.player_full_name", F.lit("")), F.nullif("p.player_name", F.lit("")), "p.player_id").alias("player_name"),
        F.col("p.team_id").alias("team_id"), F.coalesce(F.nullif("p.team_full_name", F.lit("")), "p.team_name").alias("team_name"))
    return first_rows(rows, ["match_id", "player_id"], [F.col("player_name")])


def pending_matches(found: DataFrame, done: DataFrame, limit: int | None = None, force: bool = False,
                    key: str = "match_id") -> DataFrame:
    """Matches found but not processed yet, by id; ``force`` returns all of them."""
    ids = found.select(key).distinct()
    rest = ids if force else ids.join(done.select(key).distinct(), key, "left_anti")
    return rest.orderBy(key).limit(limit) if limit is not None else rest


def load_population(detail: DataFrame, ranking: DataFrame, key: str = "match_id") -> DataFrame:
    """All sequences: the detail table, and the ranking table for matches without detail."""
    rest = ranking.join(detail.select(key).distinct(), key, "left_anti")
    return detail.unionByName(rest, allowMissingColumns=True)


def team_names(rows: DataFrame, keys=()) -> DataFrame:
    """Team id to name; the id itself where no name is known."""
    out = rows.where(F.col("team_id").isNotNull()).groupBy(*keys, "team_id").agg(F.max("team_name").alias("team_name"))
    return out.withColumn("team_name", F.coalesce("team_name", F.col("team_id").cast("string")))


def initials(name) -> Column:
    """Initials of the first two words that are no stop word; of all words when nothing else is left."""
    words = F.filter(F.split(F.replace(col(name), F.lit("."), F.lit(" ")), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    used = F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, 2)
    text = F.array_join(F.transform(used, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("R"))


def pseudonymise_teams(rows: DataFrame, order: DataFrame, own_team, own_label: str, prefix: str, team: str = "team_id",
                       name: str = "team_label") -> DataFrame:
    """Own team to a fixed label, rivals to 'prefix n' by the order table; unlisted ones share the next n."""
    after = order.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).alias("__next"))
    out = rows.join(order.select(F.col("team_id").alias(team), F.col("place").alias("__place")), team, "left")
    out = attach_row(out, after)
    number = F.coalesce("__place", "__next").cast("string")
    label = (F.when(F.col(team) == own_team, F.lit(own_label)).when(F.col(team).isNull(), F.lit(prefix))
             .otherwise(F.concat(F.lit(prefix + " "), number)))
    return out.withColumn(name, label).drop("__place", "__next")


def match_context(events: DataFrame, order: str = "event_time", key: str = "match_id") -> DataFrame:
    """First event row of each match: date (dd/mm/yyyy) and competition, else sport and season."""
    named = present(events, COMPETITION_COLUMNS)
    picked = present(events, ["match_start_time", *named, "sport_type", "season_id"])
    first = events.groupBy(key).agg(F.min_by(F.struct(*picked), order).alias("f"))
    start = F.try_to_timestamp(F.col("f.match_start_time").cast("string")) if "match_start_time" in picked else F.lit(None).cast("timestamp")
    sport = F.col("f.sport_type") if "sport_type" in picked else F.lit(None).cast("string")
    season = F.col("f.season_id").cast("string") if "season_id" in picked else F.lit(None).cast("string")
    fallback = F.when(season.isNotNull(), F.concat(F.coalesce(sport, F.lit("FOOTBALL")), F.lit(" | temporada "), season))
    competition = F.coalesce(*[F.col(f"f.{c}").cast("string") for c in named], fallback)
    return first.select(key, F.coalesce(F.date_format(start, "dd/MM/yyyy"), F.lit(NO_DATE)).alias("match_day"),
                        competition.alias("competition"))


def match_catalogue(meta: DataFrame, context: DataFrame, scores: DataFrame, keys=("match_id",)) -> DataFrame:
    """One row per processed match: label, rival, day, score, number of sequences, last change."""
    k = list(keys)
    df = meta.join(context.select(*k, "match_day"), k, "left").join(scores.select(*k, "score"), k, "left")
    day = F.coalesce("match_day", F.lit(NO_DATE))
    label = F.concat_ws(" | ", day, "rival", F.concat(F.lit("Partido "), F.col("match_id").cast("string")))
    return df.select(*k, "team_id", label.alias("label"), "rival", day.alias("match_day"), F.coalesce("score", F.lit("vs")).alias("score"),
                     "sequences", "modified")


def catalogue_order() -> list[Column]:
    return [F.col("modified").desc(), F.col("match_id").desc()]


def club_totals(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("team_id").agg(F.count("*").alias("matches"), F.sum("sequences").alias("sequences"),
                                            F.max("modified").alias("last_change"))


def team_registry(meta: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Teams seen in the outputs with their number of matches; registered teams without any count 0."""
    seen = meta.groupBy("team_id").agg(F.count("*").alias("matches"), F.max("team_name").alias("team_name"))
    if known is None:
        return seen
    both = known.select("team_id", F.lit(0).cast("long").alias("matches"), "team_name").unionByName(seen)
    return both.groupBy("team_id").agg(F.sum("matches").alias("matches"), F.max("team_name").alias("team_name"))
