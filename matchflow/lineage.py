"""Cutting long plans: a step's rows are written to the shared checkpoint folder and read back.

Ordered passes read their input twice, so a chain of them would double the plan at every step and
recompute its start after a lost executor. A written step has neither problem.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder named by the session; on a single machine without the setting, a new temporary folder."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="matchflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table just written."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
