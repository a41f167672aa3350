"""Ranked lexical search with hashed max-sketches.

The score of a document is the sum over the query's terms of weight * impact; the impact of a term in a document depends on its count and
the document's length. Each document's impacts are folded into a sketch: a term is hashed to a coordinate, a coordinate holds
the largest impact that falls on it, rounded up to 16 bits. The width of a sketch is the power of two from ``SPREAD`` times the document's
distinct terms on, so long documents are as selective as short ones. Looking up a query's coordinates and adding weight * maximum gives an
upper bound of the score, for a batch of documents and all queries of a block at once.

Search: (1) bounds of all documents; the ``SEEDS * k`` highest of each query are scored exactly, and their k-th best score is a
threshold that the answer cannot be below. (2) In each task, documents whose bound reaches the threshold are scored exactly
in descending order of the bound, until the bound falls below the k-th best score found there or the threshold. What a task leaves out has
k better rows, so the result is exact whatever the sketches are; k rows a task and query meet in a window.

The index (length, sketch, text beside it) is written once, without a shuffle; its columns are read as needed. Statistics cover all
documents: their number, terms, and for the terms of the queries the documents that hold them. Queries are worked through in
blocks of at most ``BLOCK_TERMS`` terms and ``BLOCK_ITEMS`` items, so what tasks are sent has a fixed bound.

Defined results: texts that are NULL or have no term are no documents; queries without a term have no rows. Repeated rows are documents of
their own. Equal scores are ordered by id, NULL first; a query id given twice is one query per row. No documents or queries, no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scan, slices, small_batches

SPREAD = 8
LEAST_WIDTH = 64
STEP = 16  # impacts are below 10^6: a sixteenth of one, rounded up, has 16 bits
SEEDS = 4
BLOCK_ITEMS = 512
BLOCK_TERMS = 1 << 15
ROWS = 128
TEXT_BYTES = 1 << 20

# bytes that are no part of a term become spaces, A-Z become lower case
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "row long, id long, n long, width int, sketch binary, text binary"
FOUND = "query int, row long, bound double"
SCORED = "query int, row long, id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_norm(n, documents: int, total: int):
    return 100 - 90 + (90 * n * documents) // total


def impact(tf, norm):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class Stats:
    """Documents, terms in all, and the documents that hold each term asked for."""

    def __init__(self, documents: int, total: int, df: dict[bytes, int]):
        self.documents, self.total = documents, total
        self.weights = {t: weight(documents, n) for t, n in df.items() if n}


def _counted(vocabulary: frozenset[bytes]):
    names = sorted(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, total = Counter(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    found = terms(text)
                    documents += bool(found)
                    total += len(found)
                    held.update(vocabulary.intersection(found))
        place = {t: k for k, t in enumerate(names)}
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *(place[t] for t in held)], pa.int64()), pa.array([documents, total, *held.values()], pa.int64())],
                                         ["term", "count"])
    return run


def stats(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> Stats:
    """Counts over all documents. ``vocabulary``: at most a block's terms, so the result has a fixed bound."""
    got = (small_batches(docs).select(F.col(text).alias("text")).mapInArrow(_counted(frozenset(vocabulary)), "term long, count long")
           .groupBy("term").agg(F.sum("count").alias("count")).toArrow().to_pydict())
    counts = dict(zip(got["term"], got["count"]))
    names = sorted(vocabulary)
    return Stats(counts.get(-2, 0), counts.get(-1, 0), {names[k]: c for k, c in counts.items() if k >= 0})


def _sketched(documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                raw = batch.column("text").cast(pa.binary()).to_pylist()
                counted = [Counter(terms(t)) for t in raw]
                worded = [k for k, c in enumerate(counted) if c]
                sketches, widths, lengths = [], [], []
                for k in worded:
                    held = counted[k]
                    tf = np.fromiter(held.values(), np.int64, len(held))
                    n = int(tf.sum())
                    width = max(LEAST_WIDTH, 1 << (SPREAD * len(held) - 1).bit_length())
                    at = np.fromiter(map(zlib.crc32, held), np.int64, len(held)) & (width - 1)
                    sketch = np.zeros(width, np.uint16)
                    np.maximum.at(sketch, at, (-(-impact(tf, length_norm(n, documents, total)) // STEP)).astype(np.uint16))
                    sketches.append(sketch.tobytes())
                    widths.append(width)
                    lengths.append(n)
                if worded:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(row, row + len(worded))), batch.column("id").take(pa.array(worded)), pa.array(lengths, pa.int64()),
                        pa.array(widths, pa.int32()), pa.array(sketches, pa.binary()), pa.array([raw[k] for k in worded], pa.binary())],
                        ["row", "id", "n", "width", "sketch", "text"])
                    row += len(worded)
    return run


def index(docs: DataFrame, found: Stats, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of all documents with a term."""
    slim = small_batches(docs).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return cut(slim.mapInArrow(_sketched(found.documents, found.total), INDEX))


class Block:
    """Queries of a block with their weights, as arrays for lookups."""

    def __init__(self, queries: list[list[bytes]], found: Stats):
        self.terms = [[(t, found.weights[t]) for t in q if t in found.weights] for q in queries]
        self.documents, self.total = found.documents, found.total
        flat = [(k, t, w) for k, q in enumerate(self.terms) for t, w in q]
        self.hashes = np.array([zlib.crc32(t) for _, t, _ in flat], np.int64)
        self.weights = np.array([w * STEP for _, _, w in flat], np.float64)
        owner = np.array([k for k, _, _ in flat], np.int64)
        self.asked = np.unique(owner)
        self.first = np.searchsorted(owner, self.asked)

    def bounds(self, width: int, sketches: list[bytes]) -> np.ndarray:
        """Upper bounds (documents, asked queries); whole numbers below 2^53, so the sums are exact."""
        table = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, width)
        return np.add.reduceat(table[:, self.hashes & (width - 1)] * self.weights, self.first, axis=1)

    def score(self, query: int, held: dict[bytes, int], n: int) -> int:
        norm = length_norm(n, self.documents, self.total)
        return sum(w * impact(held[t], norm) for t, w in self.terms[query] if t in held)

    def of_batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows of equal sketch width with their bounds."""
        for whole in batches:
            for lot in slices(whole, "sketch", TEXT_BYTES):
                widths = lot.column("width").to_numpy()
                for width in np.unique(widths).tolist():
                    rows = np.flatnonzero(widths == width)
                    for k in range(0, len(rows), ROWS):
                        batch = lot.take(pa.array(rows[k:k + ROWS]))
                        yield batch, self.bounds(width, batch.column("sketch").to_pylist())


def _highest(block: Block, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((most, len(block.asked)))
        names = np.full(best.shape, -1, np.int64)
        for batch, bounds in block.of_batches(batches):
            new = bounds > best[-1]
            if new.any():
                best = np.concatenate([best, np.where(new, bounds, 0)])
                names = np.concatenate([names, np.broadcast_to(batch.column("row").to_numpy()[:, None], bounds.shape)])
                order = np.argsort(-best, axis=0, kind="stable")[:most]
                best, names = np.take_along_axis(best, order, 0), np.take_along_axis(names, order, 0)
        held = best > 0
        query = np.broadcast_to(block.asked, best.shape)[held]
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(names[held]), pa.array(best[held])], ["query", "row", "bound"])
    return run


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], ["query", "row", "id", "score"])


def _seeded(block: Block, seeds: dict[int, list[int]]):
    """Exact scores of the rows named in ``seeds`` (row -> queries)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, i, n, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "n", "text"))):
                held = Counter(terms(text))
                out += [(q, row, i, block.score(q, held, n)) for q in seeds[row]]
            yield _scored(out)
    return run


def _rescored(block: Block, thresholds: dict[int, int], k: int):
    """The task's k best rows of each query among those whose bound reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {int(q): [] for q in block.asked}
        least = np.array([max(thresholds.get(int(q), 0), 1) for q in block.asked], np.float64)
        for batch, bounds in block.of_batches(batches):
            reach = bounds >= least
            if not reach.any():
                continue
            ids, rows, lengths, texts = (batch.column(c) for c in ("id", "row", "n", "text"))
            counted: dict[int, Counter] = {}
            for at in np.flatnonzero(reach.any(0)).tolist():
                q = int(block.asked[at])
                for d in np.flatnonzero(reach[:, at])[np.argsort(-bounds[reach[:, at], at], kind="stable")].tolist():
                    if bounds[d, at] < least[at]:
                        break
                    held = counted.get(d) or counted.setdefault(d, Counter(terms(texts[d].as_py())))
                    score = block.score(q, held, lengths[d].as_py())
                    if score >= least[at]:
                        i = ids[d].as_py()
                        best[q].append((-score, i is not None, i or 0, rows[d].as_py()))
                        if len(best[q]) >= 4 * k:
                            best[q] = sorted(best[q])[:k]
                            least[at] = max(least[at], -best[q][-1][0])
        yield _scored([(q, row, i if known else None, -score) for q, found in best.items() for score, known, i, row in sorted(found)[:k]])
    return run


def _leading(rows: DataFrame, order: list, k: int) -> DataFrame:
    once = Window.partitionBy("query").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(once)).where(F.col("rank") <= k)


def block_search(indexed: DataFrame, block: Block, k: int) -> DataFrame:
    """(query, rank, id, score) of the block's queries."""
    slim = indexed.select("row", "width", "sketch")
    found = _leading(slim.mapInArrow(_highest(block, SEEDS * k), FOUND), [F.col("bound").desc(), "row"], SEEDS * k)
    seeds: dict[int, list[int]] = {}
    for r in found.select("query", "row").collect():  # at most BLOCK_ITEMS * SEEDS * k
        seeds.setdefault(r["row"], []).append(r["query"])
    named = F.broadcast(indexed.sparkSession.createDataFrame([(r,) for r in seeds], "row long"))
    first = indexed.select("row", "id", "n", "text").join(named, "row").mapInArrow(_seeded(block, seeds), SCORED)
    kth = _leading(first, [F.col("score").desc()], k).where(F.col("rank") == k).select("query", "score").collect()
    best = indexed.select("row", "id", "n", "width", "sketch", "text").mapInArrow(_rescored(block, {r["query"]: r["score"] for r in kth}, k), SCORED)
    return cut(_leading(best, [F.col("score").desc(), F.col("id").asc_nulls_first(), "row"], k).select("query", F.col("rank").cast("int").alias("rank"), "id", "score"))


def _blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """(id, distinct terms) of the queries in blocks; rows come to the driver one partition after the other."""
    block, size = [], 0
    for r in queries.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        asked = list(dict.fromkeys(terms((r["t"] or "").encode())))
        if block and (len(block) == BLOCK_ITEMS or size + len(asked) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((r["i"], asked))
        size += len(asked)
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """The k best documents of each query: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    out, indexed = spark.createDataFrame([], f"{item_id} long, rank int, {doc_id} long, score long"), None
    for block in _blocks(queries, item_id, item_text):
        found = stats(docs, {t for _, asked in block for t in asked}, text)
        if not found.weights:
            continue
        indexed = index(docs, found, doc_id, text) if indexed is None else indexed
        best = block_search(indexed, Block([asked for _, asked in block], found), k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"query int, {item_id} long")
        out = out.union(best.join(F.broadcast(names), "query").select(item_id, "rank", F.col("id").alias(doc_id), "score"))
    return out


def op11(spark, sf):
    return search(scan(spark, sf, "documents"), scan(spark, sf, "benchmark"))


_TERMS = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS t FROM d) GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r), c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, {_TERMS} AS t FROM benchmark)),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), c),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN n USING (r), c GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""

QUERIES = {"op11_lexical": op11}
SQL = {"op11_lexical": OP11_SQL}
