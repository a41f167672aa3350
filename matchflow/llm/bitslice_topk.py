"""Exact top-k search by integer inner product over a bit-sliced index.

Components are turned into integers. A segment of rows stores, for each component, one bitmap per bit ("slice").
The score of a block of queries is added up with bitmap arithmetic: the leading slices of each component, times the leading
bits of each query's component, go through carry-save adders, which yields the slices of a lower bound of every row's score. The k-th
largest bound is found from the most significant slice downward. Rows whose bound is within the known error of it
are the boundary: their remaining slices are read and their scores worked out exactly, so the result is exact.

Segments hold a fixed number of cells and query blocks a fixed number of queries; each pair of a segment and a block meets in one
row of an equi join, and sends k rows per query on. Rows are dealt round-robin, so equal vectors don't gather.

Defined results: rows with a NULL id, a NULL vector, or a NULL or non-finite component take no part. Shorter vectors are filled up with
0. Rows with the query's id are not its candidates; a query id that repeats is asked once, with its smallest vector. Ties go to the
smaller id; repeated rows are candidates each. Fewer than k candidates are all returned; no rows in, no rows out. Components are
expected below 2^20 in size. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scan, small_batches

SEGMENT_CELLS = 1 << 19
BLOCK_QUERIES = 512
GROUP = 64
ROW_SLICES, QUERY_BITS = 9, 9
SEGMENT = "seg int, n int, dims int, bits int, ids binary, low binary, slices binary"
QUERIES_OF = "qb int, q int, dims int, qids binary, queries binary"
FOUND = "query_id long, vec_id long, score long"
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long"))


def _table(batches, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix filled up with 0) of all rows of a partition."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    t = pa.Table.from_batches(got).combine_chunks()
    lists = t.column(column).combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(1, int(size.max()))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return t.column("vec_id").to_numpy().astype(np.int64), out


def sliced(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest value per component, slices[component, bit, word]); bit 0 is the least significant."""
    low = rows.min(0)
    lifted = (rows - low).T
    bits = max(1, int(lifted.max()).bit_length())
    n = rows.shape[0]
    padded = np.zeros((lifted.shape[0], -(-n // 64) * 64), np.int64)
    padded[:, :n] = lifted
    planes = (padded[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return low, np.packbits(planes.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)


def _segment(batches):
    ids, rows = _table(batches, "v")
    if len(ids):
        low, slices = sliced(rows)
        yield pa.RecordBatch.from_pydict({
            "seg": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
            "dims": pa.array([rows.shape[1]], pa.int32()), "bits": pa.array([slices.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
            "low": pa.array([low.tobytes()], pa.binary()), "slices": pa.array([slices.tobytes()], pa.binary())})


def _block(batches):
    ids, rows = _table(batches, "v")
    if len(ids):
        yield pa.RecordBatch.from_pydict({
            "qb": pa.array([TaskContext.get().partitionId()], pa.int32()), "q": pa.array([len(ids)], pa.int32()),
            "dims": pa.array([rows.shape[1]], pa.int32()), "qids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([rows.tobytes()], pa.binary())})


class Adder:
    """Adds bitmaps of weight 2^p column by column; three of one weight become one and a carry."""

    def __init__(self):
        self.level: dict[int, list[np.ndarray]] = defaultdict(list)

    def push(self, p: int, bitmap: np.ndarray) -> None:
        while True:
            held = self.level[p]
            held.append(bitmap)
            if len(held) < 3:
                return
            a, b, c = held
            half = a ^ b
            self.level[p] = [half ^ c]
            bitmap, p = (a & b) | (half & c), p + 1

    def slices(self) -> list[np.ndarray]:
        out, p = [], 0
        while self.level and p <= max(self.level):
            held = self.level[p]
            if len(held) == 2:
                a, b = held
                held = [a ^ b]
                self.push(p + 1, a & b)
            out.append(held[0] if held else None)
            p += 1
        return out


def _count(bitmap: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmap).sum(1, dtype=np.int64)


def kth_largest(slices: list, valid: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th largest value per row of bitmaps, from the most significant slice downward."""
    sure = np.zeros(len(valid), np.int64)
    open_ = valid
    value = np.zeros(len(valid), np.int64)
    for p in range(len(slices) - 1, -1, -1):
        if slices[p] is None:
            continue
        high = open_ & slices[p]
        n = _count(high)
        enough = sure + n >= k
        value += np.where(enough, 1 << p, 0)
        sure = np.where(enough, sure, sure + n)
        open_ = np.where(enough[:, None], high, open_ & ~slices[p])
    return value


def at_least(slices: list, valid: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmap of the columns whose value is ``bound`` or more."""
    above, equal = np.zeros_like(valid), valid
    for p in range(len(slices) - 1, -1, -1):
        s = slices[p] if slices[p] is not None else np.zeros_like(valid)
        bit = ((bound >> p) & 1).astype(bool)[:, None]
        above = np.where(bit, above, above | (equal & s))
        equal = np.where(bit, equal & s, equal & ~s)
    return above | equal


def search(ids: np.ndarray, low: np.ndarray, slices: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int,
           row_slices: int = ROW_SLICES, query_bits: int = QUERY_BITS):
    """Yields (query number, row ids, scores) of the k best rows of a segment for each query."""
    dims, bits, words = slices.shape
    wide = max(dims, queries.shape[1])
    if queries.shape[1] < wide:
        queries = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
    queries = queries[:, :dims]  # components beyond the segment's meet zeros
    drop = max(0, bits - row_slices)
    size = np.abs(queries)
    cut = max(0, int(size.max()).bit_length() - query_bits) if size.size else 0
    coarse, rest = size >> cut, size & ((1 << cut) - 1)
    error = ((coarse << cut) * ((1 << drop) - 1) + rest * ((1 << bits) - 1)).sum(1)
    base = (queries * low).sum(1) - np.where(queries < 0, size, 0).sum(1) * ((1 << bits) - 1)
    real = np.zeros(words * 64, np.uint8)
    real[:len(ids)] = 1
    real = np.packbits(real, bitorder="little").view(np.uint64)
    for at in range(0, len(qids), GROUP):
        some = slice(at, min(at + GROUP, len(qids)))
        sign = np.where(queries[some] < 0, ONES, np.uint64(0))
        adder = Adder()
        for d in range(dims):
            for b in range(drop, bits):
                x = slices[d, b] ^ sign[:, d, None]
                for j in range(query_bits):
                    on = (coarse[some, d] >> j) & 1
                    if on.any():
                        adder.push(b - drop + j, x & np.where(on, ONES, np.uint64(0))[:, None])
        total = adder.slices()
        valid = np.broadcast_to(real, (len(qids[some]), words)).copy()
        for i, q in enumerate(qids[some]):
            for own in np.flatnonzero(ids == q):
                valid[i, own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        wanted = np.minimum(k, _count(valid))
        bound = kth_largest(total, valid, wanted)
        near = at_least(total, valid, np.maximum(0, bound - (-(-error[some] >> (drop + cut)))))
        marks = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")
        for i in range(len(marks)):
            rows = np.flatnonzero(marks[i])
            if not len(rows):
                continue
            q = queries[at + i]
            planes = (slices[:, :, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            lifted = (planes.astype(np.int64) << np.arange(bits)[None, :, None]).sum(1)
            lifted = np.where(q[:, None] < 0, (1 << bits) - 1 - lifted, lifted)
            score = np.abs(q) @ lifted + base[at + i]
            best = np.lexsort((ids[rows], -score))[:k]
            yield at + i, ids[rows[best]], score[best]


def _searched(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, low = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["low"], np.int64)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(r["dims"], r["bits"], -1)
                qids = np.frombuffer(r["qids"], np.int64)
                queries = np.frombuffer(r["queries"], np.int64).reshape(r["q"], -1)
                found = list(search(ids, low, slices, qids, queries, k))
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(qids[[f[0] for f in found]], [len(f[1]) for f in found])),
                        pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                        ["query_id", "vec_id", "score"])
    return run


def segments(rows: DataFrame, count: int, dims: int) -> tuple[DataFrame, int]:
    """The index: one row per segment, numbered from 0."""
    n = max(1, -(-count * max(1, dims) // SEGMENT_CELLS))
    return small_batches(rows).repartition(n).mapInArrow(_segment, SEGMENT), n


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query; both frames hold vec_id and v, integer vectors."""
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    index, n = segments(rows, count, dims)
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    m = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocks = asked.repartition(m).mapInArrow(_block, QUERIES_OF).drop("dims")
    pairs = (index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
             .join(blocks.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["seg", "qb"]))
    found = pairs.select("dims", "bits", "ids", "low", "slices", "q", "qids", "queries").mapInArrow(_searched(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part, with integer vectors."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector)).alias("v"))


def op2(spark, sf):
    rows = usable(scan(spark, sf, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 10"""

QUERIES = {"op2_bitslice_topk": op2}
SQL = {"op2_bitslice_topk": OP2_SQL}
