"""Near-duplicate classes by improved consistent weighted sampling (ICWS) of TF-IDF shingles.

A text is a weighted set of its five-word shingles, weight = count * idf. Document frequencies are counted over all documents in
a hashed table of fixed size (a shingle's frequency is its bucket's), so one table of bounded size serves any corpus. The idf is
1 + IDF_GAIN * ln(N / df): the spread is kept small because the common shingles of a large group of near copies are frequent
by that very group.

ICWS draws 60 consistent samples of each set (random variates come from a table by the shingle's hash); 15 bands of four put
texts of similarity 0.8 together with probability 0.9996. Equal sets are one node, so exact copies are never paired. Candidates:

* every group is compared with its hub, the node that shares most bands with others (groups of one family share one hub);
* groups of up to SMALL nodes are also compared pair by pair, but for pairs that are known to be of one class by the links with hubs so far;
* the texts of larger groups are dealt to blocks of about BLOCK shingles; the tiles, pairs of blocks next to their hub, are compared exactly, each in one
  task: every text with the hub, then those not linked to it with all others that are not known to be of one class by then and can be like them by
  their weights, by the triangle inequality at the hub, and by their samples. A tile returns the few links that join its texts as all of them do;
* hubs of more than MOST_BLOCKS blocks have their groups regrouped without them. Texts that are linked to the hub and so near to it that, by the triangle inequality, no text that is not linked
  there can be 0.8 like them, go. Each other text is cut to its head: its shingles that the hub lacks, then those of the hub,
  the rarer first in each part, until less than 0.8 of its weight is left. Two texts of similarity 0.8 have a common shingle in their
  heads (what is left of either is too little). Groups of one shingle that the hub lacks hold all such texts that have one in common. Two texts
  without any differ in all that the hub lacks of them: one has at most 1/9 of its weight there, the other at most 1/4. Such texts are grouped by what they
  change in the hub (see ``changes``), or, far from it, by the rest of their heads; groups without a text of 1/9 are left out. Groups whose texts are known to
  be of one class are left out, too.

This goes on until no group is left that can hold a link of two classes. From the regrouping NESTED on, the size up to which pairs are compared is
4 * SMALL and doubles each time, so that it ends whatever the texts. Candidates are
verified by the exact weighted Jaccard similarity (0.8 or more); classes are the connected components of the links. In small groups
samples that agree are counted first, so that the shingles of hopeless pairs are not read.

Defined results: a text without a word (NULL and empty too) is alone. A text of fewer than five words is one shingle. Repeated rows are exact
copies. NULL ids sort first. The class id is the smallest id of the class, whose row is kept. No rows in, no rows out.
Extra columns are ignored by ``classes`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, cut, rows_of, scan, slices, small_batches, tidy
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 15, 4
SAMPLES = BANDS * ROWS
SMALL = 16
# agreements of 60 samples: 0.8 gives 48 +- 3.1, fewer than 34 once in 200,000; 24 stands for a similarity of 0.4
LIKELY, ALIKE = 34, 24
DF_BITS = 18
NESTED = 4
IDF_GAIN = 0.05
# two texts without a common shingle outside their hub: one has at most this share of its weight there
FEW_MORE = (1 - SIMILARITY) / (1 + SIMILARITY)
VARIATES = 1 << 14
# two such texts both lack at most this share of their weight at the hub
LACKED = (1 - SIMILARITY) / (1 + SIMILARITY) * (1 + 1 / SIMILARITY)
# from this similarity to their hub on, such texts are grouped by what they change in it
CHANGED = 0.3
TEXT_BYTES = 1 << 20
WORD = re.compile(r"\w+")
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("_"), *range(128, 256)]] = True
GRID, GRID_LEVELS = 64, 64
FACTOR = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

# shingles of the texts of a block, and the most blocks of a hub whose pairs are all compared
BLOCK, MOST_BLOCKS = 1 << 20, 32

NODES = "row long, id long, v long, n int, f1 long, f2 long, bands array<long>, sign binary"
SETS = "node long, shingles binary, counts binary, sign binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words of each text). Words are found in one array of bytes; each distinct one is hashed once."""
    lowered = []
    for t in texts:
        t = (t or "").lower()
        if not t.isascii() and not all(c.isascii() or c.isalnum() for c in set(t)):
            t = " ".join(WORD.findall(t))
        lowered.append(t.encode("utf-8", "surrogatepass") + b" ")
    data = np.frombuffer(b"".join(lowered), np.uint8)
    inside = WORD_BYTES[data]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    edges = np.r_[0, np.cumsum([len(b) for b in lowered])].astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    offsets = np.r_[np.cumsum(inside)[starts] - 1, inside.sum()].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    named = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return named[words.indices.to_numpy()], np.diff(np.searchsorted(starts, edges))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text in order, their counts, number of shingles of each text)."""
    h, size = _words(texts)
    doc = np.repeat(np.arange(len(texts)), size)
    total = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total = total * np.uint64(FACTOR) + h[k:len(total) + k]
    whole = doc[:len(total)] == doc[SHINGLE - 1:] if len(total) else np.zeros(0, bool)
    shingles, owner = _mixed(total[whole]), doc[:len(total)][whole]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        start = np.cumsum(size) - size
        few = []
        for i in short.tolist():
            value = int(size[i])
            for x in h[start[i]:start[i] + size[i]].tolist():
                value = (value * FACTOR + x + 1) & MASK
            few.append(value)
        shingles = np.concatenate([shingles, _mixed(np.array(few, np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        shingles, owner = shingles[order], owner[order]
    if not len(shingles):
        return shingles, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
        shingles[low:high].sort()
    first = np.flatnonzero(np.r_[True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])])
    counts = np.diff(np.r_[first, len(shingles)])
    return shingles[first], counts, np.bincount(owner[first], minlength=len(texts))


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _frequencies(batches):
    found, docs = np.zeros(1 << DF_BITS, np.int64), 0
    for whole in batches:
        for batch in slices(whole, "text", TEXT_BYTES):
            shingles, _, n = shingle_sets(batch.column("text").to_pylist())
            docs += int((n > 0).sum())
            bucket, owner = _bucket(shingles), np.repeat(np.arange(len(n)), n)
            if len(bucket):
                new = np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]
                found += np.bincount(bucket[new], minlength=len(found))
    held = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[docs, found[held]])], ["bucket", "df"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """idf of each bucket over all texts; the table has a fixed size whatever the corpus."""
    table = (texts.select("text").mapInArrow(tidy(_frequencies), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow())
    df = np.zeros(1 << DF_BITS, np.int64)
    bucket, count = table.column("bucket").to_numpy(), table.column("df").to_numpy()
    n = int(count[bucket == -1].sum())
    df[bucket[bucket >= 0]] = count[bucket >= 0]
    return idf_of(df, n)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + IDF_GAIN * np.log(max(n, 1) / np.maximum(df, 1)).clip(0)).astype(np.float32)


class Sampler:
    """ICWS in logarithms: the smallest value of a sample names the sampled (shingle, level).

    The variates of a shingle come from a table by its hash. Log-weights are rounded to 1 / GRID (the exact similarity is not); the values of all slots at
    the lowest GRID_LEVELS weights are worked out once, larger weights as they come. A value and 32 bits of the shingle's own hash are one
    64-bit key, so one minimum settles shingles of one slot, and a sample names its shingle: long texts agree no more often than they are alike.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, VARIATES) + 1e-3
        self.beta = rng.random(VARIATES)
        self.log_c = np.log(rng.gamma(2, 1, VARIATES))
        self.odd = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = np.uint64(64 - int(np.log2(VARIATES)))
        low = np.repeat(np.arange(GRID_LEVELS), VARIATES)
        self.table = self._keys(low, np.tile(np.arange(VARIATES), GRID_LEVELS))

    def _keys(self, level: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The values of weights exp(level / GRID), as unsigned numbers of the same order in the upper 32 bits."""
        r = self.r[slot]
        value = (self.log_c[slot] + r * self.beta[slot] - r - r * np.floor(level / GRID / r + self.beta[slot])).astype(np.float32)
        bits = value.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return ordered.astype(np.uint64) << np.uint64(32)

    def samples(self, shingles: np.ndarray, log_weights: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Samples (texts, K) of the sets; texts without shingles must be left out."""
        start = np.cumsum(n) - n
        level = np.rint(log_weights * GRID).astype(np.int64)
        high = np.flatnonzero(level >= GRID_LEVELS)
        base = np.where(level < GRID_LEVELS, level, 0) * VARIATES
        out = np.empty((len(n), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            product = shingles * odd
            slot = (product >> self.shift).view(np.int64)
            key = self.table[base + slot]
            if len(high):
                key[high] = self._keys(level[high], slot[high])
            key |= product & np.uint64(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat(key, start)
        return _mixed(out)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    bits = np.ascontiguousarray(samples).reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(ROWS):
        key = _mixed(key * np.uint64(FACTOR) + bits[:, :, r])
    return key.view(np.int64)


def signs(samples: np.ndarray) -> np.ndarray:
    """Two bytes of each sample: enough to count agreements of two texts."""
    return (_mixed(np.ascontiguousarray(samples) + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)


def _fingerprint(shingles: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(shingles.tobytes() + counts.astype(np.int64).tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _nodes(idf: np.ndarray):
    def run(batches):
        sampler = Sampler()
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                shingles, counts, n = shingle_sets(batch.column("text").to_pylist())
                keys, marks = np.zeros((len(n), BANDS), np.int64), np.zeros((len(n), SAMPLES), np.uint16)
                if len(shingles):
                    log_weights = np.log(counts * idf[_bucket(shingles)]).astype(np.float32)
                    samples = sampler.samples(shingles, log_weights, n[n > 0])
                    keys[n > 0], marks[n > 0] = band_keys(samples), signs(samples)
                ends = np.cumsum(n)
                prints = [_fingerprint(shingles[e - k:e], counts[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(n))), batch.column("id"), batch.column("v"), pa.array(n.astype(np.int32)),
                    pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                    pa.array([m.tobytes() for m in marks], pa.binary())], ["row", "id", "v", "n", "f1", "f2", "bands", "sign"])
                row += len(n)
    return run


def _sets(batches):
    for whole in batches:
        for batch in slices(whole, "text", TEXT_BYTES):
            shingles, counts, n = shingle_sets(batch.column("text").to_pylist())
            sets, many, end = [], [], 0
            for k in n.tolist():
                c = counts[end:end + k]
                sets.append(shingles[end:end + k].tobytes())
                many.append(b"" if (c == 1).all() else c.astype(np.int32).tobytes())
                end += k
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary()), pa.array(many, pa.binary()), batch.column("sign")],
                                             ["node", "shingles", "counts", "sign"])


def _weights(shingles: np.ndarray, counts: bytes, idf: np.ndarray) -> np.ndarray:
    w = idf[_bucket(shingles)].astype(np.float64)
    return w * np.frombuffer(counts, np.int32) if counts else w


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller over sum of larger weights; shingles are sorted and distinct."""
    _, i, j = np.intersect1d(a, b, True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both / (float(wa.sum()) + float(wb.sum()) - both)


def head(a: np.ndarray, wa: np.ndarray, hub: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """(head of a text next to a hub, how many of it the hub lacks, whether the hub lacks little of the text)."""
    known = np.isin(a, hub, True)
    order = np.lexsort((a, -idf[_bucket(a)], known))
    total = wa.sum()
    left = total - np.cumsum(wa[order])
    kept = order[:int(np.argmax(left < SIMILARITY * (1 - 1e-9) * total)) + 1]
    return a[kept], int((~known[kept]).sum()), bool(wa[~known].sum() <= FEW_MORE * (1 + 1e-9) * total)


def changes(a: np.ndarray, wa: np.ndarray, hub: np.ndarray, wh: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """(listed changes that a text makes to the shingles of a hub, those in front that meet the changes of texts not linked to the hub).

    A change is a shingle of the hub with less weight or (inverted) with more; d is the weight of all changes and of what the hub lacks. Two texts a, b of
    similarity 0.8 have d(a) + d(b) - 2 * common <= (A + B) / 9, so common >= (e(a) + e(b)) / 2 with e = d - A / 9. A text has e > H / 9 if it is not linked
    to the hub, at least -H / 9 in any case, and at least e(a) - 2.5 / 9 * A if it is like a. In an order made for the hub, rare changes first, each text
    lists changes until those left weigh less than must be common. So two texts alike, one of them not linked, without a common shingle outside the hub
    have a listed change in common."""
    at = np.minimum(np.searchsorted(hub, a), len(hub) - 1)
    known = hub[at] == a
    weight = -wh
    weight[at[known]] += wa[known]
    # a shingle is missing in those texts of the hub's family that do not hold it; shares of all texts tell about how many that are
    share = np.exp((1 - idf[_bucket(hub)].astype(np.float64)) / IDF_GAIN)
    family = np.quantile(share, 0.75)
    order = np.lexsort((hub, np.where(weight > 0, share, np.maximum(1.1 * family - share, 0.05 * family))))
    order = order[weight[order] != 0]
    size = np.abs(weight[order])
    left = size.sum() - np.cumsum(size) + size
    total, most = wa.sum(), wh.sum() / 9
    e, error = size.sum() + wa[~known].sum() - total / 9, 1e-9 * (total + most)
    front, every = (int((left >= (e + max(least, e - 2.5 / 9 * total)) / 2 - error).sum()) for least in (most, -most))
    named = np.where(weight > 0, ~hub, hub)[order]
    return (named[:every], front) if e > most else (named[:front], 0)


def _listed(a: np.ndarray, wa: np.ndarray, hub: np.ndarray, wh: np.ndarray, idf: np.ndarray, sim: float) -> tuple[np.ndarray, int, int, int, bool]:
    """(what is listed of a text next to a hub, how many of it are shingles that the hub lacks, how many more are changes, how many of these are in front,
    whether the hub lacks little); after the changes, the rest of the head. Two texts alike without a common shingle outside the hub both have changes or
    both the rest of a head, by the triangle inequality."""
    shingles, own, few = head(a, wa, hub, idf)
    more, front, rest = a[:0], 0, a[:0]
    if wa[~np.isin(a, hub, True)].sum() <= LACKED * (1 + 1e-9) * wa.sum():
        if sim >= CHANGED - 1e-9:
            more, front = changes(a, wa, hub, wh, idf)
        if sim <= CHANGED + 1 - SIMILARITY + 1e-9:
            rest = shingles[own:]
    return np.concatenate([shingles[:own], more, rest]), own, len(more), front, few


def _compared(idf: np.ndarray):
    """(a, b, sim, more, own, changed, front, few) of each pair; from more on: what ``_listed`` has of a next to its hub b, if it is asked for."""
    def run(batches):
        for batch in batches:
            got = batch.to_pydict()
            sims, lists = [], []
            for sa, ca, sb, cb, large in zip(got["sa"], got["ca"], got["sb"], got["cb"], got["large"]):
                a, b = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                wa, wb = _weights(a, ca, idf), _weights(b, cb, idf)
                sims.append(weighted_jaccard(a, wa, b, wb))
                lists.append(_listed(a, wa, b, wb, idf, sims[-1]) if large else (a[:0], 0, 0, 0, False))
            more, own, changed, front, few = zip(*lists) if lists else ([],) * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("a"), batch.column("b"), pa.array(sims, pa.float64()), pa.array([m.view(np.int64) for m in more], pa.list_(pa.int64())),
                pa.array(own, pa.int32()), pa.array(changed, pa.int32()), pa.array(front, pa.int32()), pa.array(few, pa.bool_())],
                ["a", "b", "sim", "more", "own", "changed", "front", "few"])
    return run


def joining_links(sets: list[np.ndarray], weights: list[np.ndarray], marks: np.ndarray, hub: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of texts next to a hub that join them as all their links do; all texts are given by their places. With ``block``, only texts of different
    blocks are compared with each other. Texts not linked to the hub are compared with all that can be like them and are not joined to them yet."""
    size, total = np.array([len(a) for a in sets]), np.array([w.sum() for w in weights])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    places = np.split(place, np.cumsum(size)[:-1])
    held, label, found = np.zeros(place.max() + 1), np.arange(len(sets)), []

    def similar(u: int, others: np.ndarray) -> np.ndarray:
        held[places[u]] = weights[u]
        least = np.minimum(held[np.concatenate([places[v] for v in others])], np.concatenate([weights[v] for v in others]))
        held[places[u]] = 0
        both = np.add.reduceat(least, np.r_[0, np.cumsum(size[others])[:-1]])
        sim = both / (total[u] + total[others] - both)
        for k in np.flatnonzero(np.abs(sim - SIMILARITY) < 1e-9).tolist():  # on the border the order of a sum counts
            sim[k] = weighted_jaccard(sets[u], weights[u], sets[others[k]], weights[others[k]])
        return sim

    def join(u: int, others: np.ndarray) -> None:
        for v in others[np.unique(label[others], return_index=True)[1]].tolist():
            if label[u] != label[v]:
                found.append((u, v))
                label[label == label[v]] = label[u]

    rest = np.flatnonzero(np.arange(len(sets)) != hub)
    if not len(rest):
        return found
    near = np.ones(len(sets))
    near[rest] = similar(hub, rest)
    join(hub, rest[near[rest] >= SIMILARITY])
    far, linked = rest[near[rest] < SIMILARITY], rest[near[rest] >= SIMILARITY]
    for n, u in enumerate(far.tolist()):
        others = np.concatenate([far[n + 1:], linked])
        able = (label[others] != label[u]) & (np.abs(near[others] - near[u]) <= 1 - SIMILARITY + 1e-9)
        able &= np.minimum(total[others], total[u]) >= SIMILARITY * (1 - 1e-9) * np.maximum(total[others], total[u])
        if block is not None:
            able &= block[others] != block[u]
        others = others[able]
        others = others[(marks[others] == marks[u]).sum(1) >= ALIKE]
        if len(others):
            join(u, others[similar(u, others) >= SIMILARITY])
    return found


def _tile(idf: np.ndarray):
    def run(key, table):
        hub, i, j = (k.as_py() for k in key)
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        weights = [_weights(s, c, idf) for s, c in zip(sets, table.column("counts").to_pylist())]
        marks = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        found = np.array(joining_links(sets, weights, marks, int(np.flatnonzero(node == hub)[0]), None if i == j else block), np.int64).reshape(-1, 2)
        return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})
    return run


def _tiled(near: DataFrame, sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (a, b) that join the texts of the large groups of each hub of at most MOST_BLOCKS blocks. A text goes to the tiles of its block with every
    block, the hub to all tiles."""
    members = near.where("tiled").select("hub", F.col("a").alias("node"), "blocks").distinct()
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tiles = members.withColumn("tile", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(block, x) AS i, greatest(block, x) AS j))")))
    pairs = F.expr("flatten(transform(sequence(0, blocks - 1), x -> transform(sequence(x, blocks - 1), y -> struct(x AS i, y AS j))))")
    hubs = members.select("hub", F.col("hub").alias("node"), "blocks", F.lit(-1).alias("block")).distinct().withColumn("tile", F.explode(pairs))
    dealt = tiles.unionByName(hubs).select("hub", "tile.i", "tile.j", "node", "block")
    return dealt.join(sets, "node").groupBy("hub", "i", "j").applyInArrow(_tile(idf), "a long, b long")


def _hubs(held: DataFrame, nested: int, cut) -> DataFrame:
    """(key, hub) of groups: the node with the most shared bands; in the first groups, the hub of a group that holds that node, if
    it shares more, so the groups of one family, each with another part of it, have one hub; in later ones, a node not linked yet."""
    own = held.groupBy("key").agg(F.max(F.struct("open", "score", (-F.col("node")).alias("neg"))).alias("top"))
    hubs = own
    if not nested:
        best = cut(held.join(own, "key").groupBy("node").agg(F.max("top").alias("top")))
        for _ in range(3):
            up = best.select(F.col("node").alias("at"), F.col("top").alias("higher"))
            hubs = hubs.join(up, -F.col("top.neg") == F.col("at"), "left").select("key", F.greatest("top", "higher").alias("top"))
    return hubs.select("key", (-F.col("top.neg")).alias("hub"))


def _near(groups: DataFrame, score: DataFrame, nested: int, cut) -> DataFrame:
    """(key, whole, a, hub): the members of every group next to its hub; whole: to be compared pair by pair. Of groups with the same members
    (as a rule all those that one family's common shingles make) one is left; two combined hashes of the members tell them apart."""
    same = groups.groupBy("key").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"m{seed}") for seed in (1, 2)])
    sizes = same.where("c > 1").groupBy("c", "m1", "m2").agg(F.min("key").alias("key")).select("key", "c")
    held = cut(groups.join(sizes, "key").join(score, "node"))
    limit = SMALL if nested < NESTED else SMALL << (nested - NESTED + 2)
    return cut(held.join(_hubs(held, nested, cut), "key").where("node <> hub").select(
        "key", (F.col("c") <= limit).alias("whole"), F.col("node").alias("a"), "hub"))


def _agreements(batches):
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        y = np.frombuffer(b"".join(batch.column("y").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).sum(1).astype(np.int32))], ["a", "b", "agree"])


def _agreeing(pairs: DataFrame, marks: DataFrame, cut) -> DataFrame:
    """Distinct pairs (a, b) with the number of samples that agree."""
    left = marks.select(F.col("node").alias("a"), F.col("sign").alias("x"))
    right = marks.select(F.col("node").alias("b"), F.col("sign").alias("y"))
    return cut(pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y")
               .mapInArrow(_agreements, "a long, b long, agree int"))


def _among(near: DataFrame) -> DataFrame:
    """Pairs a < b of the groups to be compared pair by pair, but for those of one ``part``, which are known to be of one class or will be compared anyway."""
    some = near.where("whole").select("key", "a", "part")
    other = some.select("key", F.col("a").alias("b"), F.col("part").alias("too"))
    open_ = some.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    return some.join(open_, "key", "left_semi").join(other, "key").where("a < b AND part <> too").select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, idf: np.ndarray, cut) -> DataFrame:
    """Pairs (a, b, large) with their similarity and, if large, what is listed of a next to b."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    return cut(pairs.select("a", "b", "large").join(left, "a").join(right, "b").select("a", "b", "large", "sa", "ca", "sb", "cb")
               .mapInArrow(tidy(_compared(idf)), "a long, b long, sim double, more array<long>, own int, changed int, front int, few boolean"))


def _judged(near: DataFrame, marks: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """(pairs of texts and hubs to be compared, near with flags: like the hub by the samples; in a large group whose hub's texts are compared in tiles)."""
    size = marks.select(F.col("node").alias("a"), "n")
    large = near.where("NOT whole").select("hub", "a").distinct().join(size, "a").groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    near = cut(near.join(large, "hub", "left").withColumn("tiled", ~F.col("whole") & F.coalesce(F.col("blocks") <= MOST_BLOCKS, F.lit(False))))
    agreeing = _agreeing(near.where("NOT tiled").select("a", F.col("hub").alias("b")), marks, cut)
    like = agreeing.select("a", F.col("b").alias("hub"), (F.col("agree") >= ALIKE).alias("like"))
    near = cut(near.join(like, ["a", "hub"], "left"))
    # a text meets its hub in many groups; those of large groups are all compared
    stars = near.where("NOT tiled").groupBy("a", "hub").agg(F.max(~F.col("whole")).alias("large"), F.max("like").alias("like"))
    return stars.where("large OR like").select("a", F.col("hub").alias("b"), "large"), near


def _to_read(near: DataFrame, marks: DataFrame, cut) -> DataFrame:
    """Nodes whose shingles are needed: those like their hub, likely pairs of small groups, and the rest of large groups."""
    sides = near.select("key", "whole", "a", F.when(F.col("like"), -1).otherwise(F.col("a")).alias("part"))
    likely = _agreeing(_among(sides), marks, cut).where(F.col("agree") >= LIKELY)
    starred = near.where("like").select(F.explode(F.array("a", "hub")).alias("node"))
    rest = near.where(~F.col("whole")).select(F.explode(F.array("a", "hub")).alias("node"))
    return cut(starred.union(likely.select(F.explode(F.array("a", "b")).alias("node"))).union(rest).distinct())


def _open_rest(judged: DataFrame) -> DataFrame:
    """(hub, a, part, linked) of large groups that can still hold links: a text not linked to a hub, or one near enough to it.

    1 - similarity is a distance. Two texts of similarity 0.8 differ by at most 0.2 in their distance to the hub, so a linked text that is more than 0.2 nearer to
    the hub than every text not linked there has no link to any of them."""
    large = judged.where("NOT whole").groupBy("hub", "a").agg(F.max("sim").alias("sim"), F.max("part").alias("part"))
    large = large.withColumn("linked", F.col("sim") >= SIMILARITY)
    nearest = large.where(~F.col("linked")).groupBy("hub").agg(F.max("sim").alias("nearest"))
    return large.join(nearest, "hub").where(~F.col("linked") | (F.col("sim") <= F.col("nearest") + (1 - SIMILARITY) + 1e-9)).select("hub", "a", "part", "linked")


def _regrouped(rest: DataFrame) -> DataFrame:
    """(key, node, open) of the groups of one shingle or change next to one hub that can hold a link of two parts."""
    listed = rest.select("hub", "a", "part", "linked", "own", "changed", "front", "few", F.posexplode("more").alias("pos", "s"))
    kind = F.when(F.col("pos") < F.col("own"), "own").when(F.col("pos") < F.col("own") + F.col("changed"), "change").otherwise("rest")
    rows = listed.select(F.xxhash64("hub", "s", kind).alias("key"), F.col("a").alias("node"), "part", (~F.col("linked")).alias("open"), kind.alias("kind"),
                         "few", (F.col("pos") < F.col("own") + F.col("front")).alias("front"))
    going = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count_if(~F.col("open")).alias("near"),
                                    F.count_if("open").alias("far"), F.count_if("front").alias("fronts"), F.max("few").alias("any_few"))
    held = rows.join(going.where("low < high AND far > 0"), "key").where("kind = 'own' OR any_few")
    # changes: two texts not linked to the hub meet by those in front, one that is linked and one that is not by any
    return held.where("kind <> 'change' OR near > 0 OR (fronts > 1 AND front)").select("key", "node", "open")


def _links(near: DataFrame, stars: DataFrame, score: DataFrame, marks: DataFrame, sets: DataFrame, idf: np.ndarray, steps: Steps) -> DataFrame:
    """Verified links (a, b): near and stars of the first groups, then of those made from large groups until none are left. A round's steps
    are removed when the next round's groups are written."""
    links, nested, cut = None, 0, steps
    while True:
        done = _verified(stars, sets, idf, cut)
        starred = steps.keep(done.where(F.col("sim") >= SIMILARITY).select("a", "b"))
        tiled = steps.keep(_tiled(near, sets, idf))
        links = starred.union(tiled) if links is None else links.union(starred).union(tiled)
        parts = components(links, cut)
        linked = done.select("a", F.col("b").alias("hub"), "sim")
        judged = near.where("NOT tiled").join(linked, ["a", "hub"], "left").join(parts.withColumnRenamed("node", "a"), "a", "left")
        judged = cut(judged.select("key", "whole", "a", "hub", "sim", F.coalesce("label", "a").alias("part")))
        pairs = _agreeing(_among(judged), marks, cut).where(F.col("agree") >= LIKELY).withColumn("large", F.lit(False))
        links = links.union(steps.keep(_verified(pairs, sets, idf, cut).where(F.col("sim") >= SIMILARITY).select("a", "b")))
        if judged.where("NOT whole").isEmpty():
            steps.clear()
            return links
        groups = cut(_regrouped(_open_rest(judged).join(done.drop("sim").withColumnRenamed("b", "hub"), ["a", "hub"])))
        if groups.isEmpty():
            steps.clear()
            return links
        nested += 1
        before = steps.made()
        near = _near(groups, score, nested, cut)
        stars, near = _judged(near, marks, cut)
        steps.clear(before)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``class_id``, ``class_size``, ``kept`` and ``v``, the xxhash64 of its text."""
    slim = small_batches(docs).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("v"))
    idf = inverse_frequencies(slim)
    steps = Steps(docs.sparkSession)
    rows = steps.keep(slim.mapInArrow(tidy(_nodes(idf)), NODES))
    worded = rows.where("n > 0")
    nodes = steps.keep(worded.groupBy("f1", "f2").agg(F.min(F.struct("row", "id", "v", "n", "bands", "sign")).alias("m"))
                       .select("f1", "f2", F.col("m.row").alias("node"), "m.id", "m.v", "m.n", "m.bands", "m.sign"))
    listed = nodes.select("node", F.explode("bands").alias("key"))
    met = steps(listed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    groups = steps(listed.join(met, "key"))
    score = steps.keep(groups.groupBy("node").agg(F.sum("c").alias("score")))
    marks = nodes.select("node", "n", "sign")
    before = steps.made()
    stars, near = _judged(_near(groups.select("key", "node", F.lit(False).alias("open")), score, 0, steps), marks, steps)
    steps.clear(before)
    wanted = steps(nodes.join(_to_read(near, marks, steps), "node").select("node", "sign", F.col("id").alias("i"), F.col("v").alias("w")))
    # one plan at every size, whether or not the wanted names could be broadcast
    texts = slim.join(wanted.hint("merge"), slim["id"].eqNullSafe(F.col("i")) & slim["v"].eqNullSafe(F.col("w")))
    once = Window.partitionBy("id", "v").orderBy("node")
    texts = texts.withColumn("k", F.row_number().over(once)).where("k = 1").select("node", "sign", "text")
    sets = steps.keep(texts.mapInArrow(tidy(_sets), SETS))
    links = _links(near, stars, score, marks, sets, idf, steps)
    named = worded.join(nodes.select("f1", "f2", "node"), ["f1", "f2"]).select("row", "id", "v", "node")
    named = named.join(components(links, steps), "node", "left").select("row", "id", "v", F.coalesce("label", "node").alias("g"))
    every = cut(named.select("row", "id", "v", "g").union(rows.where("n = 0").select("row", "id", "v", (-1 - F.col("row")).alias("g"))))
    steps.remove()
    groups = cut(every.groupBy("g").agg(F.count("*").alias("class_size"), F.min(F.struct("id", "row")).alias("first")))
    return every.join(groups, "g").select(F.col("id").alias(doc_id), F.col("first.id").alias("class_id"), "class_size",
                                          (F.col("row") == F.col("first.row")).alias("kept"), "v")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns."""
    return rows_of(docs, classes(docs, doc_id, text).where("kept"), doc_id, text)


def op10(spark, sf):
    return classes(scan(spark, sf, "documents")).drop("v")


QUERIES = {"op10_near_dedup": op10}
SQL = {}
