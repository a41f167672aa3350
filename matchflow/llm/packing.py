"""Packing documents into fixed windows of tokens: concatenate and cut.

First pass: every task encodes its documents, ends each with the end id and keeps a running sum of its own tokens. The ids are written
with that local place, so nothing is encoded twice. The token totals of the tasks then go through a second running sum, whose
result is the place of each task's first token in one long line of all tokens. Second pass: place of a document = place of its task + its local
place; windows of ``length`` tokens are cut from the line by arithmetic, so a document is cut wherever a window ends and only the last window has padding.

``pieces`` needs no shuffle of tokens. ``windows`` lays whole windows: those within one task are finished in that task, and the
parts of windows that reach over a border between tasks travel as boundary records, at most two a task, and are joined by window.

Totals are summed in two levels (tasks in groups of ``GROUP``), one small row per task. They are broadcast to the second pass
while there are at most ``BROADCAST_TASKS`` of them (16 bytes each), beyond that they are merge-joined.

Defined results: a NULL text is empty; an empty text is the end id alone. Repeated rows and ids are documents of their own. The order of
documents is that of the tasks that read them. No rows in, no rows out. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, scan, slices, small_batches

LENGTH = 2048
END_ID = 1
GROUP = 1024
BROADCAST_TASKS = 1 << 20
STORE_WORDS = 300_000
TEXT_BYTES = 4 << 20
WIDTH = 4  # bytes of an id
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(9, 14), 32]] = SPACE
KINDS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = LETTER
KINDS[ord("0"):ord("9") + 1] = DIGIT
# fixed values: the vocabulary's contractions
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

TOKENS = "part long, row long, id long, before long, n long, ids binary"
FRAGMENTS = "sequence_id long, offset long, ids binary, pieces array<struct<doc_id:long,start:long,length:long,offset:long>>"


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words start in lower-case UTF-8 bytes whose characters beyond ASCII are all letters: runs of letters, single digits, contractions and
    runs of anything else but white space. The data must end in white space."""
    kind = KINDS[data]
    start = np.r_[True, kind[1:] != kind[:-1]] | (kind == DIGIT)
    quote = np.flatnonzero((data == ord("'")) & start)
    after = data[np.minimum(quote[:, None] + [1, 2], len(data) - 1)]
    for ending in CONTRACTIONS:
        fits = quote[(after[:, :len(ending)] == np.frombuffer(ending, np.uint8)).all(1)]
        start[fits + 1] = False
        start[fits + 1 + len(ending)] = True
    return np.flatnonzero(start & (kind != SPACE))


class BatchEncoder:
    """Encodes the texts of a batch: words are found in one array of bytes, distinct words are looked up, and words not met before are
    merged together. The store is emptied when full. Texts with special tokens or characters that are neither ASCII nor letters are split by the
    vocabulary's own pattern."""

    def __init__(self, vocabulary: bpe.Vocabulary, store: int = STORE_WORDS):
        self.v, self.store = vocabulary, store
        self.split = bpe.Encoder(vocabulary).words
        self.empty()

    def empty(self) -> None:
        self.place: dict[str, int] = {s: k for k, s in enumerate(self.v.specials)}
        self.ids = np.array([*self.v.specials.values()], np.int32)
        self.count = np.ones(len(self.ids), np.int64)
        self.start = np.arange(len(self.ids), dtype=np.int64)

    def _lowered(self, text: str) -> bytes | None:
        """The text as ``word_starts`` takes it, or None."""
        if any(s in text for s in self.v.specials):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if not all(c.isascii() or c.isalpha() for c in set(text)):
                return None
        return text.lower().encode("utf-8", "surrogatepass") + b" "

    def _places(self, words: list[str]) -> np.ndarray:
        """Places in the store of distinct words."""
        new = [w for w in words if w not in self.place]
        if new and len(self.place) + len(new) > self.store:
            self.empty()
            new = [w for w in words if w not in self.place]
        if new:
            ids, count = self.v.merge_words(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
            self.count = np.r_[self.count, count]
            self.ids = np.r_[self.ids, ids]
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def _words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts, those of odd texts last, and the text of each word)."""
        lowered = [self._lowered(t) if self.v.plain else None for t in texts]
        sizes = np.array([len(b or b"") for b in lowered], np.int64)
        data = np.frombuffer(b"".join(b for b in lowered if b) + b" ", np.uint8)
        starts = word_starts(data)
        kept = KINDS[data] != SPACE
        offsets = np.r_[np.cumsum(kept)[starts] - 1, kept.sum()].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])))
        odd = [(k, self.split(t)) for k, (t, b) in enumerate(zip(texts, lowered)) if b is None]
        if odd:
            words = pa.concat_arrays([words, *(pa.array(ws, pa.large_string()) for _, ws in odd)])
            owner = np.concatenate([owner, np.repeat([k for k, _ in odd], [len(ws) for _, ws in odd])])
        return words, owner

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        words, owner = self._words(texts)
        coded = words.dictionary_encode()
        at = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        order = np.argsort(owner, kind="stable") if len(owner) and (owner[1:] < owner[:-1]).any() else slice(None)
        at, owner = at[order], owner[order]
        count = self.count[at]
        before = np.r_[0, np.cumsum(count)]
        ids = self.ids[np.repeat(self.start[at] - before[:-1], count) + np.arange(before[-1])]
        return ids, np.bincount(owner, count, len(texts)).astype(np.int64)


def _encoded(vocabulary: bpe.Vocabulary, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(vocabulary)
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                ids, counts = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                ends = np.cumsum(counts)
                line = np.insert(ids, ends, end_id).astype("<u4")
                n = counts + 1
                stop = np.cumsum(n)
                offsets = np.r_[0, stop] * WIDTH
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(line)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), part)), pa.array(np.arange(row, row + len(n))), batch.column("id"),
                    pa.array(before + stop - n), pa.array(n), held.cast(pa.binary())], ["part", "row", "id", "before", "n", "ids"])
                row += len(n)
                before += int(stop[-1])
    return run


def tokens(docs: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass, written: the ids of each document (32 bits each, little-endian, the end id last) and their place in the task's own line."""
    slim = small_batches(docs).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return cut(slim.mapInArrow(_encoded(bpe.Vocabulary(path), end_id), TOKENS))


def task_places(tokens: DataFrame, group: int = GROUP) -> DataFrame:
    """(part, base): the place of each task's first token, by running sums within groups of tasks and over the groups."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).withColumn("group", F.floor(F.col("part") / group))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("total").alias("sum")).withColumn("all", F.lit(0))
    over = Window.partitionBy("all").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("first"))
    placed = totals.withColumn("inside", F.coalesce(F.sum("total").over(inside), F.lit(0))).join(groups, "group")
    return placed.select("part", (F.col("first") + F.col("inside")).alias("base"))


def placed(tokens: DataFrame) -> DataFrame:
    """The written ids with ``place``, the number of tokens before the document in the line of all documents."""
    bases = cut(task_places(tokens))
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_TASKS else bases.hint("merge")
    return tokens.join(bases, "part").withColumn("place", F.col("base") + F.col("before"))


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, ``start`` in the document, ``length``, ``ids``, ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence;
    ``part`` and ``place`` order the pieces."""
    line = placed(tokens)
    first, last = F.floor(F.col("place") / length), F.floor((F.col("place") + F.col("n") - 1) / length)

    def piece(k):
        start = F.greatest(k * length - F.col("place"), F.lit(0))
        n = F.least((k + 1) * length - F.col("place"), F.col("n")) - start
        return F.struct(k.alias("sequence_id"), start.alias("start"), n.alias("length"),
                        F.substring(F.col("ids"), (start * WIDTH + 1).cast("int"), (n * WIDTH).cast("int")).alias("ids"))

    found = F.explode(F.transform(F.sequence(first, last), piece))
    cut_up = line.select("part", "place", F.col("id").alias("doc_id"), F.col("n").alias("doc_tokens"), found.alias("p"))
    return cut_up.select("part", "place", "doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id",
                         (F.col("place") + F.col("p.start") - F.col("p.sequence_id") * length).alias("offset"))


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins pieces that follow each other in a task: one row per window, or part of a window, that the task holds."""
    now, found = None, []

    def rows():
        return pa.RecordBatch.from_pylist(found, schema=pa.schema([
            ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
            ("pieces", pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "offset")])))]))

    def closed():
        return {"sequence_id": now[0], "offset": now[1], "ids": b"".join(now[2]), "pieces": now[3]}

    for batch in batches:
        for p in batch.to_pylist():
            if now and (now[0] != p["sequence_id"] or now[4] != p["offset"]):
                found.append(closed())
                now = None
            now = now or [p["sequence_id"], p["offset"], [], [], p["offset"]]
            now[2].append(p["ids"])
            now[3].append({c: p[c] for c in ("doc_id", "start", "length", "offset")})
            now[4] += p["length"]
        if found:
            yield rows()
            found.clear()
    if now:
        found.append(closed())
        yield rows()


def windows(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per sequence: ``sequence_id``, its ``ids`` (binary, 32 bits each) and its ``pieces`` in order."""
    held = pieces(tokens, length).select("doc_id", "start", "length", "ids", "sequence_id", "offset").mapInArrow(_laid, FRAGMENTS)
    held = cut(held)
    whole = F.octet_length("ids") == length * WIDTH
    parts = held.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("f"))
    joined = parts.select("sequence_id", F.aggregate("f", F.lit(b""), lambda a, f: F.concat(a, f["ids"])).alias("ids"),
                          F.flatten(F.transform("f", lambda f: f["pieces"])).alias("pieces"))
    return held.where(whole).select("sequence_id", "ids", "pieces").union(joined)


def op13(spark, sf):
    found = pieces(tokens(scan(spark, sf, "documents"), bpe.word_vocabulary()))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op13_pack": op13}
SQL = {}
