"""Readers of the landed files: one folder per feed, one file per match, all matches in one DataFrame.

Every reader takes a folder or a list of files; with the files of ``list_matches`` only those are opened."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import num
from ..functions.jsontext import id_list, parse_events
from ..schemas import FILE_PATTERNS, FRAMES, SEQUENCE_SYNONYMS, TRACKING


def _match_of_file(feed: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), FILE_PATTERNS[feed], 1).try_cast("long")


def read_tracking(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Tracking CSVs with a fixed schema (no inference pass); a missing folder, or a header that differs from
    the schema, is an error. The match id falls back to the file name."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("pathGlobFilter", "*_tracking_poseedor.csv").option(
        "enforceSchema", False).schema(TRACKING).csv(folder)
    out = df.withColumn("match_id", F.coalesce("match_id", _match_of_file("tracking")))
    return out.withColumnsRenamed({"poseedor": "possessor", "tipo_posesion": "possession_side"})


def list_matches(spark: SparkSession, folder: str, feed: str = "tracking") -> DataFrame:
    """Files of a folder with match id, size in MB and change time; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "length", "modificationTime")
    out = files.withColumn("match_id", F.regexp_extract("path", FILE_PATTERNS[feed], 1).try_cast("long"))
    return out.where("match_id IS NOT NULL").select("match_id", F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
                                                    F.col("modificationTime").alias("modified"), "path")


def csv_parts(spark: SparkSession, folder: str | list[str], feed: str) -> list[DataFrame]:
    """CSV feed as text columns plus match id, one DataFrame per distinct header; an absent or empty
    folder gives an empty list. The headers are found in one distributed pass over the text."""
    if not folder:
        return []
    try:
        lines = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    except AnalysisException:
        return []
    at = lines.select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n")).where(
        F.col("path").rlike(FILE_PATTERNS[feed]))
    first = at.groupBy("path").agg(F.min_by("value", "n").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
              .option("inferSchema", False))
    parts = []
    for g in groups:
        df = reader.csv(g["paths"])
        df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
        named = F.col("match_id").try_cast("long") if "match_id" in df.columns else F.lit(None).cast("long")
        parts.append(df.withColumn("match_id", F.coalesce(named, _match_of_file(feed))))
    return parts


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_events(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Event CSVs; ``events`` stays text, ``events_parsed`` is NULL when it is not a JSON list."""
    parts = csv_parts(spark, folder, "events")
    if not parts:
        raise FileNotFoundError(str(folder))
    return union_all(parts).withColumn("events_parsed", parse_events("events"))


def first_name(columns: list[str], names) -> str | None:
    """First of the accepted names the columns have, whatever the case."""
    have = {c.strip().lower(): c for c in columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def _to_ms(name: str) -> Column:
    scale = 1000 if "sec" in name.lower() and "ms" not in name.lower() else 1
    return num(F.col(f"`{name}`")) * scale


def coalesce_schema(df: DataFrame, synonyms=SEQUENCE_SYNONYMS) -> DataFrame | None:
    """Provider sequences in canonical columns. Names in seconds become ms, the end may come from the
    duration; None when team, period, start or both end and duration are missing."""
    at = {c: first_name(df.columns, names) for c, names in synonyms.items()}
    if not (at["team_id"] and at["period"] and at["start_ms"] and (at["end_ms"] or at["duration"])):
        return None
    none = F.lit(None)
    start = _to_ms(at["start_ms"])
    end = _to_ms(at["end_ms"]) if at["end_ms"] else start + _to_ms(at["duration"])
    text = F.col(f"`{at['event_ids']}`") if at["event_ids"] else none.cast("string")
    ids = text if at["event_ids"] and dict(df.dtypes)[at["event_ids"]].startswith("array") else id_list(text)

    def number(c):
        return num(F.col(f"`{at[c]}`")) if at[c] else none.cast("double")

    def lower(c):
        return F.lower(F.col(f"`{at[c]}`").cast("string")) if at[c] else F.lit("")

    own_id = F.col(f"`{at['provider_id']}`").cast("string") if at["provider_id"] else F.concat(
        F.col(f"`{at['period']}`").cast("string"), F.lit("-"), start.cast("long").cast("string"))
    return df.select(
        "match_id", own_id.alias("provider_id"), number("team_id").cast("long").alias("team_id"),
        number("period").cast("long").alias("period"), start.alias("start_ms"), end.alias("end_ms"),
        F.coalesce(ids.cast("array<string>"), F.array().cast("array<string>")).alias("event_ids"),
        number("total_distance").alias("total_distance"), number("num_passes").alias("num_passes"),
        number("progress_distance").alias("progress_distance"), lower("progress_direction").alias("progress_direction"),
        lower("ball_status").alias("ball_status")).dropna(subset=["team_id", "period", "start_ms", "end_ms"])


def empty_sequences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "match_id long, provider_id string, team_id long, period long, start_ms double, end_ms double, "
                                     "event_ids array<string>, total_distance double, num_passes double, progress_distance double, "
                                     "progress_direction string, ball_status string")


def read_sequences(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Provider sequences in canonical form; no folder, no files or no usable columns give an empty table.
    Every header style is coalesced on its own before the union."""
    styles = [p for p in (coalesce_schema(df) for df in csv_parts(spark, folder, "sequences")) if p is not None]
    return union_all(styles) if styles else empty_sequences(spark)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Landed tracking frames, one JSON object per line, as nested columns."""
    return spark.read.schema(FRAMES).json(folder)
