"""Personal data by patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) are leftmost matches that do not overlap, with their checks. They and every other token
that could be personal data (seven or more digits, or an @) are the nodes of one graph per document: neighbouring
tokens are linked in a chain, and each token is linked to the next one that is the same but for case, spaces and
punctuation, however far away. Words without digit and @ have the fixed label O and drop out of the graph. Loopy sum-product
message passing over both kinds of links gives each token a label distribution; base spans are observed. Tokens with a label other
than O are added as spans. Skip links form a chain through the occurrences, so a token repeated n times costs n links.

Weights are fitted by pseudo-likelihood on at most ``FIT_DOCS`` documents, those with the smallest hash of their id that hold a digit;
base spans are the labels, other tokens count as O, and tokens that repeat a base span have no label.

Defined results: NULL and empty texts have no spans. Whole texts are searched. Repeated rows and ids are independent. Without
documents to fit on the weights are those of the prior, which only spread observed labels along skip links. No rows in,
no rows out. Extra columns stay; a column named ``spans`` is replaced.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import scan, small_batches

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *KINDS]
FIT_DOCS = 2000
FIT_CHARS = 20_000
SURPLUS = 8
ROUNDS = 30
DAMPING = 0.5
LEAST_BELIEF = 0.6
GRAPH_TEXTS = 2048
OBSERVED = 30.0
# log-potentials before fitting: a token is no personal data, and a skip link favours agreement
PRIOR_NONE = 2.0
PRIOR_AGREE = 6.0

NUMBERS = re.compile(r"[0-9+][0-9 ().+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+$")
TOKEN = re.compile(r"\+?\(?[0-9](?:[ .()-]{0,2}[0-9])*+")
AT_TOKEN = re.compile(r"[^\s<>()\[\]{},;:\"']+")
WORD_BEFORE = re.compile(r"([^\W\d_]{2,})[\s:=.(#-]*$")
CONTEXT = ("tel", "phone", "call", "fax", "mobile", "card", "visa", "credit", "ip", "host", "server", "address", "email", "mail", "contact")
STYLES = 7
N_FEATURES = 2 + 7 * STYLES + len(CONTEXT)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their @ in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(base spans, number areas): the areas hold all that the three number patterns can match."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    areas = []
    for m in NUMBERS.finditer(text):
        area = m.group()
        if len(area) < 7:
            continue
        at = m.start()
        areas.append((at, m.end()))
        for n in IP.finditer(area):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in n.group().split(".")):
                found.append(("ip", at + n.start(), at + n.end()))
        for n in CARD.finditer(area):
            d = _digits(n.group())
            if 14 <= len(d) <= 19 and luhn(d):
                found.append(("card", at + n.start(), at + n.end()))
        if "+" in area:
            for n in PHONE.finditer(area):
                if 10 <= len(_digits(n.group())) <= 15:
                    found.append(("phone", at + n.start(), at + n.end()))
    return found, areas


class Taken:
    """Spans of a text, asked whether any overlaps another one: by binary search over the starts and the furthest end so far."""

    def __init__(self, found: list[tuple[int, int]]):
        self.starts = [a for a, _ in sorted(found)]
        self.reach = list(itertools.accumulate((b for _, b in sorted(found)), max))

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.reach[i - 1] > a


def _edge(c: str) -> bool:
    return c.isspace() or c in "<>()[]{},;:\"'"


def nodes_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, label, key) of a text's nodes by position; label -1 for tokens that no base span covers."""
    found, areas = base_spans(text)
    nodes = [(a, b, LABELS.index(k), _key(text[a:b])) for k, a, b in found]
    taken = Taken([(a, b) for _, a, b in found])
    for at, end in areas:
        for m in TOKEN.finditer(text, at, end):
            if sum("0" <= c <= "9" for c in m.group()) >= 7 and not taken.overlaps(m.start(), m.end()):
                nodes.append((m.start(), m.end(), -1, _key(m.group())))
    at, seen, first, m = text.find("@"), -1, -1, None
    while at >= 0:
        left = at
        while left > 0 and left - 1 != seen and not _edge(text[left - 1]):
            left -= 1
        # no edge since the last sign: the token starts where that one's does
        if left > 0 and left - 1 == seen:
            left = first
        if left != first:
            m = AT_TOKEN.match(text, left)
        seen, first = at, left
        if m and m.end() - left > 5 and not taken.overlaps(left, m.end()):
            nodes.append((left, m.end(), -1, _key(m.group())))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    return sorted(nodes)


def _key(token: str) -> str:
    """What repeated and similar tokens have in common."""
    return re.sub(r"[\W_]", "", token.lower()) if "@" in token else _digits(token)


def _style(token: str) -> int:
    if "@" in token:
        return 0 if "." in token[token.rfind("@"):] else 1
    if token.startswith("+"):
        return 2
    if "." in token:
        return 3 if token.count(".") == 3 else 4
    return 5 if token.isdigit() else 6


def features(text: str, start: int, end: int) -> np.ndarray:
    token = text[start:end]
    f = np.zeros(N_FEATURES, np.float32)
    d = _digits(token)
    f[0] = 1
    f[1] = len(d) >= 14 and luhn(d)
    f[2 + STYLES * (0 if len(d) < 7 else min(6, 1 + (len(d) - 7) // 3)) + _style(token)] = 1
    m = WORD_BEFORE.search(text, max(0, start - 24), start)
    if m and m.group(1).lower() in CONTEXT:
        f[N_FEATURES - 1 - CONTEXT.index(m.group(1).lower())] = 1
    return f


@dataclass
class Graph:
    """Nodes of many documents; links never cross documents."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph_of(texts: list[str]) -> Graph:
    doc, where, x, chain, skip = [], [], [], [], []
    for i, text in enumerate(texts):
        last: dict[str, int] = {}
        first = len(doc)
        for a, b, label, key in nodes_of(text):
            n = len(doc)
            doc.append(i)
            where.append((a, b, label))
            x.append(features(text, a, b))
            if n > first:
                chain.append((n - 1, n))
            if key in last:
                skip.append((last[key], n))
            last[key] = n
    w = np.array(where, np.int64).reshape(-1, 3)
    return Graph(np.array(doc, np.int64), w[:, 0], w[:, 1], w[:, 2], np.array(x, np.float32).reshape(-1, N_FEATURES),
                 np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))


@dataclass
class Weights:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def prior() -> Weights:
    n = len(LABELS)
    unary = np.zeros((N_FEATURES, n), np.float32)
    unary[0, 0] = PRIOR_NONE
    return Weights(unary, np.zeros((n, n), np.float32), PRIOR_AGREE * np.eye(n, dtype=np.float32))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(g: Graph, steps: int = 200, rate: float = 0.5, shrink: float = 1e-3) -> Weights:
    """Pseudo-likelihood: each labelled node given the labels of its links; tokens that repeat a base span have none."""
    w = prior()
    known = g.label.copy()
    open_ = known < 0
    tied = np.zeros(len(known), bool)
    for a, b in ((0, 1), (1, 0)):
        tied[g.skip[g.label[g.skip[:, a]] > 0, b]] = True
    known[open_ & ~tied] = 0
    rows = np.flatnonzero(known >= 0)
    if not len(rows):
        return w
    eye = np.vstack([np.eye(len(LABELS), dtype=np.float32), np.zeros((1, len(LABELS)), np.float32)])
    near = []
    for links in (g.chain, g.skip):
        seen = np.zeros((len(known), len(LABELS)), np.float32)
        np.add.at(seen, links[:, 0], eye[known[links[:, 1]]])
        np.add.at(seen, links[:, 1], eye[known[links[:, 0]]])
        near.append(seen[rows])
    x, gold, start = g.x[rows], eye[known[rows]], prior()
    for _ in range(steps):
        miss = gold - _softmax(x @ w.unary + near[0] @ w.chain + near[1] @ w.skip)
        w.unary += rate * (x.T @ miss / len(rows) - shrink * (w.unary - start.unary))
        step = near[0].T @ miss / len(rows)
        w.chain += rate * ((step + step.T) / 2 - shrink * w.chain)
        step = near[1].T @ miss / len(rows)
        w.skip += rate * ((step + step.T) / 2 - shrink * (w.skip - start.skip))
    return w


def beliefs(unary: np.ndarray, links: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Loopy sum-product: label distribution per node from unary log-potentials, links (E, 2) and their log-potentials (E, L, L)."""
    n, labels = unary.shape
    if not len(links):
        return _softmax(unary)
    src = np.r_[links[:, 0], links[:, 1]]
    dst = np.r_[links[:, 1], links[:, 0]]
    table = np.concatenate([pair, pair.transpose(0, 2, 1)])
    m = np.zeros((len(src), labels))
    back = np.r_[np.arange(len(links), 2 * len(links)), np.arange(len(links))]
    for _ in range(rounds):
        total = unary.astype(np.float64)
        np.add.at(total, dst, m)
        sent = (total[src] - m[back])[:, :, None] + table
        top = sent.max(1)
        new = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - m).max()
        m = damping * m + (1 - damping) * new
        if change < 1e-4:
            break
    total = unary.astype(np.float64)
    np.add.at(total, dst, m)
    return _softmax(total)


def inferred(g: Graph, w: Weights) -> np.ndarray:
    unary = g.x @ w.unary
    seen = g.label >= 0
    unary[np.flatnonzero(seen), g.label[seen]] += OBSERVED
    links = np.concatenate([g.chain, g.skip])
    pair = np.concatenate([np.broadcast_to(w.chain, (len(g.chain), *w.chain.shape)), np.broadcast_to(w.skip, (len(g.skip), *w.skip.shape))])
    return beliefs(unary, links, pair)


def find(texts: list[str], w: Weights) -> list[list[dict]]:
    """Base and added spans of each text."""
    g = graph_of(texts)
    out: list[list] = [[] for _ in texts]
    if len(g.doc):
        p = inferred(g, w)
        best = p.argmax(1)
        sure = p.max(1) >= LEAST_BELIEF
        for i, a, b, label, guess, ok in zip(g.doc.tolist(), g.start.tolist(), g.end.tolist(), g.label.tolist(), best.tolist(), sure.tolist()):
            if label > 0:
                out[i].append((LABELS[label], a, b, True))
            elif guess > 0 and ok:
                out[i].append((LABELS[guess], a, b, False))
    return [spans.listed(f, KINDS) if f else [] for f in out]


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = FIT_DOCS, chars: int = FIT_CHARS) -> Weights:
    """Weights from at most ``limit`` documents and ``chars`` code points of each: of a share of all ids by hash that holds some times ``limit``, those
    with the smallest hash; so the tasks send on a bounded number of rows, however many they are."""
    share = max(1, docs.count() // (SURPLUS * limit))
    h = F.xxhash64(doc_id)
    picked = (docs.where((F.pmod(h, F.lit(share)) == 0) & F.col(text).rlike("[0-9]")).select(h.alias("h"), F.col(doc_id).alias("i"))
              .orderBy("h", "i").limit(limit).select("i"))
    ids = [r[0] for r in picked.collect()]
    if not ids:
        return prior()
    rows = docs.where(F.col(doc_id).isin(ids)).select(F.substring(text, 1, chars).alias("t"), h.alias("h"), F.xxhash64(text).alias("v"))
    rows = rows.orderBy("h", "v").limit(limit).collect()
    return fit(graph_of([r[0] for r in rows if r[0]]))


def personal_data(text: Column, w: Weights) -> Column:
    """Array of (kind, start, end, base)."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            out = [s for i in range(0, len(texts), GRAPH_TEXTS) for s in find(texts[i:i + GRAPH_TEXTS], w)]
            yield pa.array(out, spans.ARROW_TYPE)

    return F.arrow_udf(run, spans.SQL_TYPE)(text)


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """``docs`` with ``spans``."""
    w = weights or fitted(docs, doc_id, text)
    return small_batches(docs).drop("spans").withColumn("spans", personal_data(F.col(text), w))


def op1(spark, sf):
    return spans.digests(marked(scan(spark, sf, "documents").select("doc_id", "text")), "spans", KINDS)


QUERIES = {"op1_pii": op1}
SQL = {}
