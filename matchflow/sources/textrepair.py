"""Repair of UTF-8 text that was once read as a one-byte encoding. Arrow batches; only marked rows are touched."""

from __future__ import annotations

import gc

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that betray mis-read text, and the encodings to undo, in order.
MARKS = "[ÃÂâ\u008d\u0081�]"
ENCODINGS = ("cp1252", "latin1")
PASSES = 3
BATCH_BYTES = 8 << 20


def _undo(text: str) -> str | None:
    for encoding in ENCODINGS:
        try:
            return text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repair_text(s: pd.Series) -> pd.Series:
    # earlier batches are held by cycles of objects too few to start a collection by themselves
    gc.collect()
    out = s.copy()
    todo = s.notna() & s.str.contains(MARKS, regex=True, na=False)
    # one pass more than PASSES: the last one also runs on text that stayed marked
    for _ in range(PASSES + 1):
        if not todo.any():
            break
        fixed = out[todo].map(_undo)
        changed = fixed.notna() & (fixed != "") & (fixed != out[todo])
        out.loc[changed[changed].index] = fixed[changed]
        todo = todo & changed.reindex(todo.index, fill_value=False) & out.str.contains(MARKS, regex=True, na=False)
    return out.str.replace("[Â�]", "", regex=True)


def repair_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Repairs the given string columns, or all of them. Batches are limited by bytes as well as by rows, so that long texts cannot fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: repair_text(F.col(c)) for c in names})
