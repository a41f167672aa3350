"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every match must hold the trigrams it
names. Each run of texts in a task is one index segment: trigram -> sorted numbers of the texts that hold it,
for all trigrams any rule asks for. A rule's postings are intersected and united by its query, and only the texts
left are searched with the expression itself; a rule without mandatory trigrams searches every text. Segments are
built where the texts lie, so nothing is shuffled and a lost task is simply run again.

Base rules (assign, access, hex) find leftmost matches that do not overlap and drop those that are too short. Further rules
add spans of well-known key formats. All positions are code points, ends exclusive.

Defined results: NULL and empty texts have no spans. Whole texts are searched. Rows are independent, so repeated rows and
ids are harmless. No rows in, no rows out. Extra columns stay; a column named ``spans`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import scan, small_batches

SEGMENT_BYTES = 2 << 20
MOST_STRINGS = 64
ANY = True


@dataclass(frozen=True)
class Rule:
    """A match counts when its ``group`` has at least ``least`` characters; ``base`` rules are the contract's."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# fixed values: the searched key formats
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _all_of(parts: list):
    parts = [p for p in parts if p is not ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _one_of(parts: list):
    return ANY if any(p is ANY for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _trigrams(strings: set[bytes]):
    """Query of a text that holds one of the strings."""
    return _one_of([_all_of([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _of_items(items) -> tuple[set[bytes] | None, object]:
    """(every string the items can match, if few; a query that holds for every match)."""
    exact, needed, known = {b""}, [], True
    for op, arg in items:
        strings, query = _of_item(op, arg)
        if strings is not None and len(strings) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        known = False
        needed += [_trigrams(exact), query]
        exact = strings if strings is not None else {b""}
    return (exact if known else None), _all_of([*needed, _trigrams(exact)])


def _of_item(op, arg) -> tuple[set[bytes] | None, object]:
    if op is C.LITERAL:
        return {chr(arg).lower().encode()}, ANY
    if op is C.IN:
        chars: set[bytes] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower().encode())
            elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
                chars |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op is C.SUBPATTERN:
        return _of_items(arg[3])
    if op is C.BRANCH:
        found = [_of_items(b) for b in arg[1]]
        strings = None if any(s is None for s, _ in found) else set().union(*[s for s, _ in found])
        return strings, _one_of([q for _, q in found])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _of_items(inner)
        if high == 1 and strings is not None:
            return (strings | {b""} if low == 0 else strings), ANY
        return None, query if low else ANY
    if op in (C.ASSERT, C.ASSERT_NOT, C.AT):
        return {b""}, ANY
    return None, ANY


def trigram_query(pattern: str):
    """Trigrams, ("and", ...) and ("or", ...) of them that every text with a match holds; ANY if none are mandatory."""
    return _of_items(_parser.parse(pattern))[1]


def _named(query) -> set[bytes]:
    return set() if query is ANY else {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class Index:
    """Trigram -> numbers of the texts that hold it, for the trigrams of ``vocabulary``."""

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = vocabulary
        self.table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(vocabulary):
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def build(self, texts: list[bytes]) -> None:
        self.size = len(texts)
        data = np.frombuffer(b"\x00".join(texts).lower() + b"\x00\x00\x00", np.uint8).astype(np.uint32)
        number = self.table[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(number)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        text = np.searchsorted(starts, at, "right") - 1
        held = np.unique(number[at].astype(np.int64) * self.size + text)
        edges = np.searchsorted(held, np.arange(1, len(self.vocabulary) + 2) * self.size)
        self.postings = {t: held[edges[i]:edges[i + 1]] % self.size for i, t in enumerate(self.vocabulary)}

    def find(self, query) -> np.ndarray:
        """Sorted numbers of the texts for which the query holds."""
        if query is ANY:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted(map(self.find, query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, True) if query[0] == "and" else np.union1d(out, other)
        return out


def scan_texts(texts: list[str], rules=RULES, index: Index | None = None, plans=None, searches=None) -> list[list[dict]]:
    """Spans of each text, by way of the index."""
    plans = plans or [trigram_query(r.pattern) for r in rules]
    searches = searches or [re.compile(r.pattern) for r in rules]
    index = index or Index(sorted(set().union(*map(_named, plans))))
    index.build([t.encode("utf-8", "surrogatepass") for t in texts])
    found: list[list] = [[] for _ in texts]
    for rule, plan, search in zip(rules, plans, searches):
        for i in index.find(plan).tolist():
            found[i] += [(rule.kind, m.start(), m.end(), rule.base) for m in search.finditer(texts[i])
                         if len(m.group(rule.group)) >= rule.least]
    kinds = [r.kind for r in rules]
    return [spans.listed(f, kinds) if f else [] for f in found]


def secrets(text: Column, rules=RULES) -> Column:
    """Array of (kind, start, end, base) of the secrets in a text."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plans = [trigram_query(r.pattern) for r in rules]
        searches = [re.compile(r.pattern) for r in rules]
        index = Index(sorted(set().union(*map(_named, plans))))
        for batch in batches:
            out, segment, size = [], [], 0
            for t in batch.to_pylist():
                if segment and size + len(t or "") > SEGMENT_BYTES:
                    out += scan_texts(segment, rules, index, plans, searches)
                    segment, size = [], 0
                segment.append(t or "")
                size += len(t or "")
            if segment:
                out += scan_texts(segment, rules, index, plans, searches)
            yield pa.array(out, spans.ARROW_TYPE)

    return F.arrow_udf(run, spans.SQL_TYPE)(text)


def scanned(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``spans``."""
    return small_batches(docs).drop("spans").withColumn("spans", secrets(F.col(text), rules))


def op9(spark, sf):
    done = scanned(scan(spark, sf, "documents").select("doc_id", "text"))
    return spans.digests(done, "spans", [r.kind for r in RULES if r.base])


QUERIES = {"op9_secret_scan": op9}
SQL = {}
