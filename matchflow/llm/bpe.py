"""BPE encoding and decoding in batches.

A batch's texts are split into words; words not met before are merged together: the symbols of all of them
lie in one flat array, every round finds the rank of each neighbouring pair by binary search over the sorted pair keys,
takes each word's lowest rank and merges its pairs, and looks up again only the pairs next to a merge. Words met
before are looked up; the store of a task is emptied when it is full, which changes no result.

The vocabulary file (its path is a parameter) is read once by the driver and sent with the function. Supported files: BPE with
NFC, white-space and lower-case normalisation, a word pattern, byte symbols and a word-end suffix.

Defined results: NULL text is empty; an empty text has no ids and decodes to an empty text. NULL or unknown ids are
left out of a decoded text. Rows are independent, so repeated rows and ids are harmless. No rows in, no rows out. Extra columns
stay; a clashing output name is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scan, small_batches, tidy

# the word pattern for texts whose characters beyond ASCII are all letters; first characters tell the choices apart
PLAIN_WORDS = re.compile(r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\t-\r ]|_)+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STORE_WORDS = 150_000
SLICE_CHARS = 1 << 20
NO_RANK = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself when visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in visible else next(free)) for b in range(256)]


class Vocabulary:
    """What encoding needs of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.final = np.array([ids[s + suffix] for s in symbols], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(*ids.values(), *self.specials.values()))
        for token, i in (*ids.items(), *self.specials.items()):
            self.tokens[i] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 32 | right)
        self.keys = (left << 32 | right)[order]
        self.ranks = order.astype(np.int64)
        self.merged = merged
        # a pair's symbols are all made by earlier merges: then equal pairs of a word can be merged in one round
        made = np.full(len(self.tokens), -1, np.int64)
        np.maximum.at(made, merged, np.arange(len(merged)))
        rank = np.arange(len(merged))
        self.whole_rounds = bool(((made[left] < rank) & (made[right] < rank)).all())
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.plain = pattern == WORD_PATTERN

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NO_RANK where a pair never merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        counts = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(counts) - 1
        sym = self.inner[data]
        sym[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(words)), counts)
        rank = np.full(len(sym), NO_RANK)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.look_up(sym[inside], sym[inside + 1])
        done = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            going = np.repeat(low < NO_RANK, size)
            if not going.all():
                done.append((word[~going], sym[~going]))
                sym, word, rank, low = sym[going], word[going], rank[going], np.repeat(low, size)[going]
                if not len(sym):
                    break
            else:
                low = np.repeat(low, size)
            hit = rank == low
            at = np.flatnonzero(hit)
            if self.whole_rounds:  # in a run of one symbol every second pair
                run = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            else:  # the first pair of each word
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            beside = np.zeros(len(sym), bool)
            beside[at] = beside[at[at > 0] - 1] = True
            near = np.flatnonzero(beside)
            rank[near] = NO_RANK
            near = near[near < len(sym) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.look_up(sym[near], sym[near + 1])
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts of one task; keeps the ids of words met before."""

    def __init__(self, vocabulary: Vocabulary, store: int = STORE_WORDS):
        self.v, self.store = vocabulary, store
        self.find = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")")
        self.empty()

    def empty(self) -> None:
        self.place: dict[str, int] = {s: k for k, s in enumerate(self.v.specials)}
        self.ids = np.array([*self.v.specials.values()], np.int32)
        self.count = np.ones(len(self.ids), np.int64)
        self.start = np.arange(len(self.ids), dtype=np.int64)

    def words(self, text: str) -> list[str]:
        if any(s in text for s in self.v.specials):
            return [w for p in self.special.split(text) for w in ([p] if p in self.v.specials else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # capital sigma has one lower form here, wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if self.v.plain and all(c.isascii() or c.isalpha() for c in set(text)):
            return PLAIN_WORDS.findall(text)
        return self.find(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        listed = [self.words(t) for t in texts]
        flat = [w for ws in listed for w in ws]
        new = list(set(flat).difference(self.place))
        if new:
            if len(self.place) + len(new) > self.store:
                self.empty()
                new = list(set(flat).difference(self.place))
            ids, count = self.v.merge_words(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
            self.count = np.r_[self.count, count]
            self.ids = np.r_[self.ids, ids]
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        count = self.count[at]
        before = np.r_[0, np.cumsum(count)]
        ids = self.ids[np.repeat(self.start[at] - before[:-1], count) + np.arange(before[-1])]
        edges = np.r_[0, np.cumsum([len(ws) for ws in listed])].astype(np.int64)
        return ids, np.diff(before[edges])


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > SLICE_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode(text: Column, path: str) -> Column:
    """The text's ids, array<int>."""
    vocabulary = Vocabulary(path)

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            parts = [encoder.encode(run) for run in _runs([t or "" for t in batch.to_pylist()])]
            counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
            flat = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat, pa.int32()))

    return F.arrow_udf(tidy(ids), "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids: the tokens, special ones too, with a space between."""
    tokens = Vocabulary(path).tokens

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for row in batch:
                got = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int64)
                try:
                    out.append(" ".join([tokens[i] for i in got.tolist()]))
                except (TypeError, ValueError, IndexError):
                    out.append(" ".join(tokens[i] for i in (row.as_py() or []) if i is not None and 0 <= i < len(tokens)))
            yield pa.array(out, pa.string())

    return F.arrow_udf(tidy(texts), "string")(ids)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``."""
    own = small_batches(docs).drop("ids", "decoded")
    return own.withColumn("ids", encode(F.col(text), path)).withColumn("decoded", decode(F.col("ids"), path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    done = encoded(docs.select("doc_id", "text"), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def word_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3(spark, sf):
    return digests(scan(spark, sf, "documents"), word_vocabulary())


QUERIES = {"op3_bpe": op3}
SQL = {}
