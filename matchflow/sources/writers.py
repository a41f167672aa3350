"""Sinks: gold tables by match, published versions of them, nested CSV, the keyed result store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PUBLISHED, PUBLISHED_ROLLUP

KEYS = ["match_id", "team_id"]
MANIFEST = "manifest"


def published_names(df: DataFrame) -> DataFrame:
    """Columns under their published names."""
    names = {**PUBLISHED_ROLLUP, **PUBLISHED}
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def finite(df: DataFrame) -> DataFrame:
    """Infinite and NaN numbers to NULL."""
    bad = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in bad})


def write_match_outputs(tables: dict[str, DataFrame], folder: str, keys=("match_id",)) -> None:
    """Each table as Parquet partitioned by match; only the matches at hand are replaced. Rows are rebalanced by match:
    adaptive execution splits a match that is large and puts small ones together, by their bytes."""
    for name, df in tables.items():
        rows = finite(df).hint("rebalance", *keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{folder}/{name}")


def publish(tables: dict[str, DataFrame], folder: str, matches: DataFrame, keys=("match_id",)) -> str:
    """New versions of all tables for the given matches, seen at once or not at all; returns the name of the version.

    Every table is written under its version's name, which no reader looks at yet. The manifest (table, keys, run) is one small
    file written last: when it is there, readers take all the tables' new rows, and a table without rows of a match has none. A
    run that ends before leaves the former state."""
    keys, run = list(keys), f"r{uuid.uuid4().hex}"
    for name, df in tables.items():
        finite(df).hint("rebalance", *keys).write.partitionBy(*keys).parquet(f"{folder}/{name}/run={run}")
    named = F.explode(F.array(*[F.lit(n) for n in tables]))
    rows = matches.select(*keys).distinct().select(named.alias("table"), *keys, F.lit(run).alias("run"), F.lit(time.time_ns()).alias("published"))
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/{MANIFEST}")
    return run


def current_versions(spark: SparkSession, folder: str, name: str, keys=("match_id",)) -> DataFrame | None:
    """(keys, run): the latest version of each match of a table."""
    manifest = read_table(spark, f"{folder}/{MANIFEST}")
    if manifest is None:
        return None
    return manifest.where(F.col("table") == name).groupBy(*keys).agg(F.max_by("run", F.struct("published", "run")).alias("run"))


def read_output(spark: SparkSession, folder: str, name: str, keys=("match_id",)) -> DataFrame | None:
    """The published rows of a table; None when it has never had any. Only the folders of current versions are opened."""
    now, rows = current_versions(spark, folder, name, keys), read_table(spark, f"{folder}/{name}")
    if now is None or rows is None:
        return None
    typed = rows.withColumns({k: F.col(k).cast(now.schema[k].dataType) for k in keys})
    return typed.join(now, ["run", *keys], "left_semi").drop("run")


def write_nested_csv(df: DataFrame, folder: str) -> None:
    """CSV with nested columns as JSON text, UTF-8 with a byte order mark in the header."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    flat = df.withColumns({c: F.to_json(c) for c in nested})
    first = flat.columns[0]
    flat.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet table, or None when nothing is stored there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def match_result_store(spark: SparkSession, folder: str, name: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame],
                       force: bool = False) -> DataFrame:
    """Stored result rows of the wanted (match, team) keys; missing keys (all with ``force``) are computed,
    written and read back. The store is a table, so a lost executor only rereads it."""
    path = f"{folder}/{name}"
    have = read_table(spark, path)
    todo = wanted if force or have is None else wanted.join(have.select(*KEYS).distinct(), KEYS, "left_anti")
    if not todo.isEmpty():
        write_match_outputs({name: compute(todo)}, folder, KEYS)
    return spark.read.parquet(path).join(wanted, KEYS, "left_semi")


def list_outputs(meta: DataFrame) -> DataFrame:
    """Catalogue of processed matches, newest first."""
    return meta.select("match_id", "rival", "path", "modified").orderBy(F.col("modified").desc(), F.col("match_id").desc())
