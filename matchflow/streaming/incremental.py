"""New match files as they land: a file stream that runs once over what is new and then stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import FILE_PATTERNS

FILES = "path string, modificationTime timestamp, length long, content binary"


def landed_matches(spark: SparkSession, folder: str, feed: str = "tracking", per_batch: int | None = None) -> DataFrame:
    """Stream of (match_id, path, size) of the feed's files; contents are never read."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    files = reader.load(folder).select("path", "length")
    out = files.withColumn("match_id", F.regexp_extract("path", FILE_PATTERNS[feed], 1).try_cast("long"))
    return out.where("match_id IS NOT NULL").select("match_id", "path", "length")


def run_incremental(spark: SparkSession, folder: str, checkpoint: str, process: Callable[[DataFrame], None], *, feed: str = "tracking",
                    per_batch: int | None = None) -> StreamingQuery:
    """Processes every match whose file is new since the last run, then stops. Progress lives in the
    checkpoint folder; ``process`` gets one batch of matches (match_id, path) and must write by match (overwriting), so a
    repeated batch after a failure gives the same result."""
    def batch(df: DataFrame, _: int) -> None:
        todo = df.groupBy("match_id").agg(F.max("path").alias("path"))
        if not todo.isEmpty():
            process(todo)

    query = (landed_matches(spark, folder, feed, per_batch).writeStream.foreachBatch(batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
