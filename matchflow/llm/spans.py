"""Spans (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"
ARROW_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def listed(found: list[tuple[str, int, int, bool]], kinds: list[str]) -> list[dict]:
    """Spans by start, then by the order of their kinds."""
    order = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in
            sorted(set(found), key=lambda s: (s[1], order[s[0]], s[2]))]


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(rows: DataFrame, spans: str, kinds: list[str]) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and all spans as text."""
    base = F.filter(spans, lambda s: s["base"])
    of_base = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(of_base, lambda s: s == F.lit(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return rows.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col(spans)).alias("spans"))
