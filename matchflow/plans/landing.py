"""From newly landed files to the gold tables, one run after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lineage import cut
from ..sources import readers as rd
from ..sources import writers as wr
from ..streaming.incremental import run_incremental
from .season import analyse_matches, published_tables

FAILED = "failed"
FAILED_ROW = "match_id long, path string, error string, at timestamp"


class LandingFailed(RuntimeError):
    """Some matches could not be analysed; ``matches`` holds their ids and errors."""

    def __init__(self, matches: list[tuple[int, str]]):
        super().__init__("; ".join(f"match {m}: {error}" for m, error in matches))
        self.matches = matches


def files_of(spark: SparkSession, folder: str, feed: str, matches: DataFrame) -> list[str]:
    """Paths of a feed's files of the given matches; one name per match of a run comes to the driver."""
    try:
        files = rd.list_matches(spark, folder, feed)
    except AnalysisException:
        return []
    return [r["path"] for r in files.join(matches.select("match_id"), "match_id", "left_semi").select("path").orderBy("path").collect()]


def season_tables(tracking: DataFrame, events: DataFrame, sequences: DataFrame, **how) -> dict[str, DataFrame]:
    return published_tables(analyse_matches(tracking, events, sequences, **how))


def failed_matches(spark: SparkSession, gold: str) -> DataFrame:
    """Matches whose latest attempt failed: match_id, path, error, at."""
    found = wr.read_output(spark, gold, FAILED)
    return spark.createDataFrame([], FAILED_ROW) if found is None else found.select("match_id", "path", "error", "at")


def process_landed(spark: SparkSession, landing: str, gold: str, checkpoint: str, *, per_batch: int | None = None,
                   tables: Callable[..., dict[str, DataFrame]] = season_tables, matches: list[int] | None = None, force: bool = False,
                   strict: bool = False, **how) -> StreamingQuery | None:
    """Analyses the matches whose tracking file is new and those whose latest attempt failed, and publishes their tables; only their
    files are opened. ``matches`` names the matches to analyse instead, ``force`` takes all landed ones, analysed before or not; the
    stream of new files is then left as it is (None is returned).

    All tables of a batch become visible at once (``writers.publish``). When a batch fails its matches are tried one by one, and those that fail again are
    recorded in the table ``failed`` instead of ending the run; a later success clears the record. With ``strict`` the run ends in
    ``LandingFailed`` when it is through and some of its matches have failed."""
    failures: list[tuple[int, str]] = []

    def run(todo: DataFrame) -> None:
        paths = [r["path"] for r in todo.select("path").orderBy("path").collect()]
        found = tables(rd.read_tracking(spark, paths), rd.read_events(spark, files_of(spark, f"{landing}/events", "events", todo)),
                       rd.read_sequences(spark, files_of(spark, f"{landing}/sequences", "sequences", todo)), **how)
        wr.publish({**found, FAILED: spark.createDataFrame([], FAILED_ROW)}, gold, todo)

    def process(todo: DataFrame) -> None:
        todo = cut(todo.select("match_id", "path"))
        try:
            run(todo)
        except Exception as exc:  # a match that cannot be analysed must not hold up the others
            ids = [r["match_id"] for r in todo.select("match_id").orderBy("match_id").collect()]
            if len(ids) > 1:
                for i in ids:
                    process(todo.where(F.col("match_id") == i))
                return
            told = f"{type(exc).__name__}: {exc}"[:2000]
            failures.append((ids[0], told))
            wr.publish({FAILED: todo.select("match_id", "path", F.lit(told).alias("error"), F.current_timestamp().alias("at"))}, gold, todo)

    query = None
    if matches is not None or force:
        landed = rd.list_matches(spark, f"{landing}/tracking")
        some = landed if matches is None else landed.where(F.col("match_id").isin(matches))
        todo = some.groupBy("match_id").agg(F.max("path").alias("path"))
        if not todo.isEmpty():
            process(todo)
    else:
        again = failed_matches(spark, gold)
        if not again.isEmpty():
            process(again)
        query = run_incremental(spark, f"{landing}/tracking", checkpoint, process, per_batch=per_batch)
    if strict and failures:
        raise LandingFailed(failures)
    return query
