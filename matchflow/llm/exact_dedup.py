"""Exact dedup by deterministic block naming.

Normalised texts (A-Z lower-cased) are cut into fixed-size blocks. The distinct blocks are sorted and their places
become integer names; adjacent pairs of names are sorted and named again, level by level, until each document has
one name. Two documents of as many blocks have the same name exactly when their texts are equal: names come from
comparing block contents and pairs themselves. A fingerprint only carries a name back to the blocks; it is
checked to lead to one content each, and is widened and taken again if not, so a collision cannot merge texts.

The full text is shuffled once, as distinct blocks combined before the shuffle; everything else moves
integers. Groups of copies are counted before they meet, and joins that carry names back may be split.

Defined results: NULL text is empty; empty texts are one group. NULL ids sort below all others. Of repeated rows with one id,
exactly one stays. No rows in, no rows out. Extra columns are ignored by ``named_groups`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of, scan, slices, small_batches, tidy

BLOCK_BYTES = 4096
FINGERPRINT_BITS = 128
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

PARTS = "row long, id long, v long, sha string, n int, pos int, f1 long, f2 long"
BLOCKS = "f1 long, f2 long, block binary"


def _fingerprint(block: bytes, bits: int, salt: int) -> tuple[int, int]:
    digest = hashlib.blake2b(block, digest_size=16, salt=struct.pack("<q", salt)).digest()
    a, b = struct.unpack("<qq", digest)
    if bits >= 128:
        return a, b
    return (a, 0) if bits == 64 else (a % (1 << min(bits, 63)), 0)


def _cut_up(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


def _texts(batch):
    return [b"" if t is None else t.translate(LOWER) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _parts(size: int, bits: int, salt: int):
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for i, v, text in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), _texts(batch)):
                    blocks = _cut_up(text, size)
                    sha = hashlib.sha256(text).hexdigest()
                    for pos, block in enumerate(blocks):
                        out.append((row, i, v, None if pos else sha, len(blocks), pos, *_fingerprint(block, bits, salt)))
                    row += 1
                cols = list(zip(*out)) or [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["row", "id", "v", "sha", "n", "pos", "f1", "f2"])
    return run


def _blocks(size: int, bits: int, salt: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = {b for text in _texts(batch) for b in _cut_up(text, size)}
                keys = [_fingerprint(b, bits, salt) for b in found]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                                  pa.array(list(found), pa.binary())], ["f1", "f2", "block"])
    return run


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Sorted rows get their places as names: equal rows are in one partition, so a place names one content."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(slim: DataFrame, size: int = BLOCK_BYTES, bits: int = FINGERPRINT_BITS) -> tuple[DataFrame, DataFrame]:
    """(parts, names): the blocks of each row with their fingerprints, and fingerprint -> integer name."""
    salt = 0
    while True:
        names = cut(_named(slim.select("text").mapInArrow(tidy(_blocks(size, bits, salt)), BLOCKS).distinct(), ["block"])
                    .select("f1", "f2", "name"))
        if names.groupBy("f1", "f2").count().where("count > 1").isEmpty():
            return cut(slim.mapInArrow(tidy(_parts(size, bits, salt)), PARTS)), names
        bits, salt = min(128, 2 * bits), salt + 1


def named_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = BLOCK_BYTES,
                 bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and ``v``, the xxhash64 of its text as it was."""
    slim = small_batches(docs).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"),
                                      F.xxhash64(text).alias("v"))
    parts, names = block_names(slim, size, bits)
    level = parts.join(names, ["f1", "f2"]).select("row", "n", "pos", "name")
    level = cut(level)
    done = level.where("n = 1").select("row", "n", "name")
    longest = parts.agg(F.max("n")).first()[0] or 1
    width = 1
    while width < longest:
        pairs = (level.where(F.col("n") > width).groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        pairs = cut(pairs)
        found = cut(_named(pairs.select("a", "b").distinct(), ["a", "b"]))
        level = cut(pairs.join(found, ["a", "b"]).select("row", "n", "pos", "name"))
        width *= 2
        done = done.unionByName(level.where((F.col("n") <= width)).select("row", "n", "name"))
    rows = cut(done.join(parts.where("pos = 0").select("row", "id", "v", "sha"), "row"))
    groups = cut(rows.groupBy("n", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep")))
    return rows.join(groups, ["n", "name"]).select(
        F.col("id").alias(doc_id), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"), "v")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    return rows_of(docs, named_groups(docs, doc_id, text, **how).where("kept"), doc_id, text)


def op4(spark, sf):
    return named_groups(scan(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)"""

QUERIES = {"op4_exact_dedup": op4}
SQL = {"op4_exact_dedup": OP4_SQL}
