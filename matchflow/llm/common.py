"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import checkpoint_folder, cut

__all__ = ["Steps", "ascii_lower", "cut", "rows_of", "scan", "slices", "small_batches", "tidy"]

BATCH_BYTES = 8 << 20


def scan(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in; ``translate`` walks code points."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def small_batches(df: DataFrame) -> DataFrame:
    """Limits Arrow batches by bytes as well as by rows, so that long texts cannot fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text is about ``limit`` bytes; every row is in one of them."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def tidy(run: Callable) -> Callable:
    """The same function of batches; when a task is done with it, its worker gives the memory that is free by then back to the system. Spark keeps workers for
    later stages, so that what they hold would lie beside the memory of all stages to come."""
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library: free memory stays with the worker
            pass

    return whole


def rows_of(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (id, and v, the xxhash64 of the text) names, one of each, all columns."""
    names = kept.select(F.col(doc_id).alias("__k"), F.col("v").alias("__kv"))
    rows = docs.withColumn("__v", F.xxhash64(text))
    same = rows[doc_id].eqNullSafe(F.col("__k")) & rows["__v"].eqNullSafe(F.col("__kv"))
    once = Window.partitionBy(doc_id, "__v").orderBy("__v")
    found = rows.join(names, same, "left_semi").withColumn("__n", F.row_number().over(once))
    return found.where("__n = 1").select(*docs.columns)


class Steps:
    """Written steps of one operator, removed from the checkpoint folder once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"
        self.passing: list[str] = []

    def _written(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def __call__(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a step that ``clear`` removes."""
        out, path = self._written(df)
        self.passing.append(path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a step that stays until ``remove``."""
        return self._written(df)[0]

    def made(self) -> list[str]:
        return list(self.passing)

    def clear(self, paths: list[str] | None = None) -> None:
        """Removes the given steps, or all but the kept ones."""
        for path in self.passing[:] if paths is None else paths:
            self._delete(path)
            self.passing.remove(path)

    def remove(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
