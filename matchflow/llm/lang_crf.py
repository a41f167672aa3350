"""Language identification with a linear-chain conditional random field over words.

Each word of a text is labelled; features are its affixes and inner character n-grams (2 to 4, with marks
at the word's ends) and its own identity (the learned lexicon), hashed into one weight table. Transitions between labels are
learned too, so code-switched text changes label where the words do. Forward-backward over the whole document gives
every word's label distribution; the document's language is the label with the largest sum, its score that label's share.

The chain is as long as the document. It is cut into blocks of 64 words whose transfer matrices are multiplied for all
blocks of a batch at once; the blocks' borders are then passed along, so the result is that of one unbroken chain.

Fitted on the driver by gradient steps on the conditional likelihood, on at most ``FIT_DOCS`` labelled documents per language (those
with the smallest hash of their id) and ``FIT_CHARS`` of each; only text and lang are used, of documents that are not held
out. Pieces of different documents are chained, so that switches are seen.

Defined results: NULL text or text without a letter is ``und`` with score 0; so is every text if there is nothing to learn
from. NULL ids are not held out. Rows are independent, so repeated rows are harmless. Ties take the smaller label. No rows in, no
rows out. Extra columns stay; clashing output names are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scan, small_batches, tidy

UNKNOWN = "und"
FIT_DOCS = 300
MOST_LABELS = 128
SURPLUS = 4
FIT_CHARS = 3000
TABLE = 1 << 18
BLOCK = 64
STORE_WORDS = 150_000
SLICE_CHARS = 1 << 20
PIECE_WORDS, PIECES = 12, 8
WORDS = re.compile(r"[^\W\d_]+")
RESULT = "struct<lang:string,score:double,switches:int>"


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        signs = {ord(c): " " for c in set(text) if c.isalnum() and not c.isalpha() and not c.isascii()}
        if signs:
            text = text.translate(signs)
    return WORDS.findall(text)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table places of all features one word after the other, number of features of each word)."""
    joined = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    places, owners = [], []
    h = c.copy()
    for n in (2, 3, 4):
        h = h[:len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:]
        inside = word[:len(h)] == word[n - 1:]
        g = h[inside]
        places.append(((g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n) >> np.uint64(46)).astype(np.int64))
        owners.append(word[:len(h)][inside])
    places.append(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) >> 14 for w in words], np.int64))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(places)[order], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray
    steps: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-potentials of each word for each label."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        places, count = hashed(words)
        first = np.cumsum(count) - count
        return np.add.reduceat(self.table[places], first, 0) / np.sqrt(count)[:, None].astype(np.float32)


def _normal(a: np.ndarray, axes) -> np.ndarray:
    return a / a.sum(axes, keepdims=True)


def marginals(logp: np.ndarray, lengths: np.ndarray, steps: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label distributions of the words of many chains (one after the other), by forward-backward."""
    return messages(logp, lengths, steps, block)[0]


def pair_marginals(p: np.ndarray, ahead: np.ndarray, steps: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Joint label distributions of the words ``second`` and those before them: forward message x step x what the word and all after it say,
    which is its distribution without the forward message."""
    a = np.exp(steps - steps.max())
    before = ahead[second - 1]
    rest = p[second] / np.maximum(before @ a, 1e-300)
    return before[:, :, None] * a * rest[:, None, :]


def messages(logp: np.ndarray, lengths: np.ndarray, steps: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(label distributions, forward messages) of the words of many chains."""
    n, labels = logp.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((0, labels))
    e = np.exp(logp - logp.max(1, keepdims=True)).astype(np.float64) + 1e-30
    a = np.exp(steps - steps.max())
    blocks = -(-lengths // block)
    total = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    chain = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = first_block[chain] + inside // block, inside % block
    grid = np.ones((total, block, labels))
    real = np.zeros((total, block, 1), bool)
    grid[row, col], real[row, col] = e, True
    # the first word of a chain comes after no step
    head = np.zeros((total, 1, 1), bool)
    head[first_block[blocks > 0]] = True
    eye = np.eye(labels)
    product = np.broadcast_to(eye, (total, labels, labels)).copy()
    for k in range(block):
        new = (np.where(head, eye, a) if k == 0 else a) @ (eye * grid[:, k, None, :])
        product = np.where(real[:, k, :, None], product @ new, product)
        product = _normal(product, (1, 2))
    left, right = np.full((total, labels), 1 / labels), np.full((total, labels), 1 / labels)
    order = np.argsort(-blocks, kind="stable")
    longest = int(blocks.max())
    alive = np.searchsorted(-blocks[order], -np.arange(1, longest + 1), "right")
    v = np.full((len(lengths), labels), 1 / labels)
    for j in range(longest):
        on = order[:alive[j]]
        at = first_block[on] + j
        left[at] = v[on]
        v[on] = _normal((v[on, None, :] @ product[at])[:, 0], 1)
    v = np.full((len(lengths), labels), 1 / labels)
    for j in range(longest - 1, -1, -1):
        on = order[:alive[j]]
        at = first_block[on] + j
        right[at] = v[on]
        v[on] = _normal((product[at] @ v[on, :, None])[:, :, 0], 1)
    ahead = np.empty((total, block, labels))
    v = left
    for k in range(block):
        moved = np.where(head[:, 0], v, v @ a) if k == 0 else v @ a
        v = np.where(real[:, k], _normal(moved * grid[:, k], 1), v)
        ahead[:, k] = v
    v = right
    forward = ahead[row, col]
    for k in range(block - 1, -1, -1):
        ahead[:, k] = _normal(ahead[:, k] * v, 1)
        back = (grid[:, k] * v) @ a.T
        if k:
            v = np.where(real[:, k], _normal(back, 1), v)
    return ahead[row, col], forward


def fit(texts: list[str], langs: list[str], epochs: int = 3, rate: float = 0.5, batch: int = 40, seed: int = 1) -> Model | None:
    """Weights and transitions by AdaGrad on the conditional log-likelihood."""
    labels = sorted(set(langs))
    pieces = []
    for text, lang in zip(texts, langs):
        ws = words_of(text)
        pieces += [(ws[i:i + PIECE_WORDS], labels.index(lang)) for i in range(0, len(ws), PIECE_WORDS)]
    if not pieces:
        return None
    n = len(labels)
    model = Model(labels, np.zeros((TABLE, n), np.float32), np.zeros((n, n), np.float32))
    g_table, g_steps = np.full((TABLE, n), 1e-3, np.float32), np.full((n, n), 1e-3, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for low in range(0, len(order), batch * PIECES):
            took = [pieces[i] for i in order[low:low + batch * PIECES]]
            flat = [w for ws, _ in took for w in ws]
            gold = np.repeat([lab for _, lab in took], [len(ws) for ws, _ in took])
            size = [sum(len(ws) for ws, _ in took[i:i + PIECES]) for i in range(0, len(took), PIECES)]
            lengths = np.array(size, np.int64)
            place = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            unique = list(place)
            at = np.array([place[w] for w in flat])
            p, ahead = messages(model.scores(unique)[at], lengths, model.steps)
            miss = np.eye(n)[gold] - p
            per_word = np.zeros((len(unique), n))
            np.add.at(per_word, at, miss)
            places, count = hashed(unique)
            grad = np.repeat(per_word / np.sqrt(count)[:, None], count, 0).astype(np.float32)
            used, back = np.unique(places, return_inverse=True)
            total = np.zeros((len(used), n), np.float32)
            np.add.at(total, back, grad)
            g_table[used] += total ** 2
            model.table[used] += rate * total / np.sqrt(g_table[used])
            # transitions: observed pairs against expected ones
            start = np.zeros(len(flat), bool)
            start[np.cumsum(lengths) - lengths] = True
            nxt = np.flatnonzero(~start)
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[nxt - 1], gold[nxt]), 1)
            step = (seen - pair_marginals(p, ahead, model.steps, nxt).sum(0)).astype(np.float32)
            g_steps += step ** 2
            model.steps += rate * step / np.sqrt(g_steps)
    return model


class Labeller:
    """Labels the texts of one task; keeps the scores of words met before."""

    def __init__(self, model: Model, store: int = STORE_WORDS):
        self.m, self.store = model, store
        self.empty()

    def empty(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(self.m.labels)), np.float32)

    def word_labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(label distribution of every word of all texts, number of words of each text)."""
        listed = [words_of(t) for t in texts]
        flat = [w for ws in listed for w in ws]
        new = list(set(flat).difference(self.place))
        if new:
            if len(self.place) + len(new) > self.store:
                self.empty()
                new = list(set(flat))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.known = np.concatenate([self.known, self.m.scores(new)])
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(ws) for ws in listed], np.int64)
        return marginals(self.known[at], lengths, self.m.steps), lengths

    def documents(self, texts: list[str]) -> list[dict]:
        p, lengths = self.word_labels(texts)
        ends = np.cumsum(lengths)
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
        share = (total[ends] - total[ends - lengths]) / np.maximum(lengths, 1)[:, None]
        best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
        change = np.r_[0, np.cumsum(np.r_[0, best[1:] != best[:-1]])] if len(p) else np.zeros(1, np.int64)
        top = share.argmax(1)
        out = []
        for i, n in enumerate(lengths.tolist()):
            if not n:
                out.append({"lang": UNKNOWN, "score": 0.0, "switches": 0})
            else:
                out.append({"lang": self.m.labels[top[i]], "score": float(min(1.0, max(0.0, share[i, top[i]]))),
                            "switches": int(change[ends[i]] - change[ends[i] - n + 1])})
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = FIT_DOCS,
           chars: int = FIT_CHARS) -> Model | None:
    """The model of at most ``limit`` documents of each language, ``chars`` code points of each from a hashed place on."""
    able = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    h = F.xxhash64(F.lit(7), doc_id)
    # of each language a share of the ids by hash that holds some times ``limit``: tasks send on a bounded number of rows
    counts = able.groupBy(lang).count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages; a model has a table column for each")
    shares = [F.lit(v) for r in counts for v in (r[0], max(1, r[1] // (SURPLUS * limit)))]
    if not shares:
        return None
    some = able.where(F.pmod(h, F.element_at(F.create_map(*shares), F.col(lang))) == 0)
    order = Window.partitionBy(lang).orderBy("h", "i")
    ids = (some.select(F.col(lang), h.alias("h"), F.col(doc_id).alias("i")).withColumn("n", F.row_number().over(order))
           .where(F.col("n") <= limit).select("i").distinct())
    picked = able.join(F.broadcast(ids), F.col(doc_id).eqNullSafe(F.col("i")), "left_semi")
    first = F.pmod(h, F.greatest(F.char_length(text) - chars + 1, F.lit(1))).cast("int") + 1
    rows = picked.select(F.substring(F.col(text), first, F.lit(chars)).alias("t"), F.col(lang).alias("l"), h.alias("h")).collect()
    rows.sort(key=lambda r: (r["h"], r["l"], r["t"]))
    return fit([r["t"] for r in rows], [r["l"] for r in rows])


def languages(text: Column, model: Model | None) -> Column:
    """Struct of ``lang``, ``score`` and ``switches``, the number of places where the word labels change."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("switches", pa.int32())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            if labeller is None:
                out = [{"lang": UNKNOWN, "score": 0.0, "switches": 0}] * len(texts)
            else:
                out, part, size = [], [], 0
                for t in texts:
                    if part and size + len(t) > SLICE_CHARS:
                        out += labeller.documents(part)
                        part, size = [], 0
                    part.append(t)
                    size += len(t)
                out += labeller.documents(part) if part else []
            yield pa.array(out, kind)

    return F.arrow_udf(tidy(run), RESULT)(text)


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``switches``; fits a model on them unless one is given."""
    model = model or fitted(docs, doc_id, text, lang)
    own = small_batches(docs).drop("lang_pred", "score", "switches", "__l")
    found = own.withColumn("__l", languages(F.col(text), model))
    return found.select(*own.columns, F.col("__l.lang").alias("lang_pred"), F.col("__l.score").alias("score"),
                        F.col("__l.switches").alias("switches"))


def op7(spark, sf):
    docs = scan(spark, sf, "documents")
    found = small_batches(docs.select("doc_id", "text")).withColumn("l", languages(F.col("text"), fitted(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("l.lang").alias("lang_pred"), "l.score", "l.switches")


QUERIES = {"op7_lang_id": op7}
SQL = {}
