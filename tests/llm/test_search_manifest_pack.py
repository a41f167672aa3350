"""Ranked search, Merkle manifest and packing against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.llm import bpe, lexical, merkle, packing

SF = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
LONG = " ".join(f"Word{i} stands, here" for i in range(20_000))
ROWS = [(1, WORDS, "en", "a", 7), (2, WORDS.upper(), "en", "a", None), (2, WORDS.upper(), "en", "a", None), (3, None, None, None, None),
        (4, "", "de", "b", 0), (None, "a text without an id\nand two lines", "en", "b", 1), (5, LONG, "en", "a", 9), (6, "x" * 300_000, None, "b", 2),
        (7, "12345 !!! \n\n ٣ don't <|endoftext|>'s", "en", None, 3), (8, WORDS, None, "ä", 4), (3, "other text of the id three", "en", "c", 5)]
CLASH = ["g", "key", "hash", "pos", "n", "part", "at", "path", "leaf", "row", "id", "ids", "place", "rank", "score", "query", "width", "before", "base", "p"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.withColumns({c: F.lit(f"mine {c}") for c in CLASH}).repartition(3).cache()


# ---- search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [re.sub("[A-Z]+", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, queries, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, many = sum(n for *_, n in held), len(held)
    out = []
    for item, text in queries:
        scores = []
        for i, c, n in held:
            m = 10 + (90 * n * many) // total
            s = 0
            for t in set(plain_terms(text)):
                if t in c:
                    df = sum(t in x for _, x, _ in held)
                    s += math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_like_all_pairs(spark, docs, k):
    asked = [(1, "the big WOLF"), (1, "lazy"), (2, None), (3, "!!!"), (None, "id three stands"), (4, "nowhere else"), (5, WORDS * 3), (6, "٣ Straße")]
    queries = spark.createDataFrame(asked, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = found(lexical.search(docs, queries, k))
    want = plain_search([r[:2] for r in ROWS], [q for q in asked], k)
    assert got == want


def test_search_in_blocks_and_with_narrow_sketches(spark, monkeypatch):
    """Sketches as narrow as can be make loose bounds and change no result; nor do blocks of queries."""
    rnd = random.Random(4)
    words = ["w%d" % int(rnd.paretovariate(0.6)) for _ in range(20_000)]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 30, 300])))) for i in range(400)]
    asked = [(i, " ".join(rnd.choices(words, k=8))) for i in range(20)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(asked, "item_id long, text string")
    want = plain_search(texts, asked, 10)
    assert found(lexical.search(d, q)) == want
    monkeypatch.setattr(lexical, "SPREAD", 1)
    monkeypatch.setattr(lexical, "LEAST_WIDTH", 2)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    assert found(lexical.search(d, q)) == want


def test_bounds_are_bounds(docs):
    st = lexical.stats(docs, {t for r in ROWS for t in lexical.terms((r[1] or "").encode())})
    asked = [lexical.terms(WORDS.encode()), [b"nowhere"], lexical.terms(b"other text of 12345")]
    block = lexical.Block(asked, st)
    for r in lexical.index(docs, st).collect():
        held = Counter(lexical.terms(bytes(r["text"])))
        bounds = block.bounds(r["width"], [bytes(r["sketch"])])[0]
        for at, q in enumerate(block.asked.tolist()):
            assert bounds[at] >= block.score(q, held, r["n"])


def test_search_of_nothing(spark, docs):
    none = docs.where("false")
    queries = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert found(lexical.search(none, queries)) == [] and found(lexical.search(docs, queries.where("false"))) == []
    assert found(lexical.search(docs.where("text IS NULL OR text = ''"), queries)) == []


# ---- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = re.sub("[A-Z]+", lambda m: m.group().lower(), text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_tree(leaves):
    """(root, siblings left and right of each leaf, level by level)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for leaf, place in enumerate(at):
            run = place // 16 * 16
            paths[leaf].append(("".join(level[run:place]), "".join(level[place + 1:run + 16])))
        at = [a // 16 for a in at]
        level = [h(*level[k:k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for r, path in zip(own, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            back = plain_leaf(r, changed)
            for left, right in path + above:
                back = h(left, back, right)
            out.append((r[0], plain_leaf(r), subroot, root, h(*(a + b for a, b in path + above)), back, back == root))
    return sorted(out, key=repr)


def manifest_of(spark, df, tmp):
    df.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    got = merkle.op12(spark, str(tmp))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_manifest(spark, docs, tmp_path):
    assert manifest_of(spark, docs, tmp_path) == plain_manifest(ROWS)


@pytest.mark.parametrize("size", [1, 16, 17, 300])
def test_manifest_sizes(spark, tmp_path, size):
    """A lone leaf, a full run, a run of one, three levels; a source with most rows beside many small ones."""
    rows = [(i, f"Text {i}", "en", "big" if i % 3 else f"s{i}", i) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest_of(spark, df.repartition(4), tmp_path)
    assert got == plain_manifest(rows)
    assert all(r[6] == (zlib.crc32(str(r[0]).encode()) % 5 != 0) for r in got)


def test_manifest_of_nothing(spark, docs, tmp_path):
    assert manifest_of(spark, docs.where("false"), tmp_path) == []


# ---- packing

def library_ids(text):
    from tokenizers import Tokenizer
    library_ids.t = getattr(library_ids, "t", None) or Tokenizer.from_file(bpe.word_vocabulary())
    return library_ids.t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_pieces(got, want, length):
    """Pieces cover every document once and fill every sequence but the last. ``want``: lists of ids, as often as they occur."""
    line = {}
    for p in got:
        assert p["length"] == len(p["ids"]) // 4 and 0 < p["length"] <= length
        line.setdefault(p["sequence_id"], []).append(p)
    assert sorted(line) == list(range(len(line)))
    for s, ps in line.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == length or s == len(line) - 1
    found, now = [], []
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        now += np.frombuffer(p["ids"], "<u4").tolist()
        assert p["start"] + p["length"] == len(now)
        if len(now) == p["doc_tokens"]:
            found.append((p["doc_id"], now))
            now = []
    assert not now and sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_pieces(spark, docs, length):
    some = docs if length > 1 else docs.where("length(text) < 1000 OR text IS NULL")
    tokens = packing.tokens(some, bpe.word_vocabulary())
    want = [(i, library_ids(t)) for i, t, *_ in ROWS if length > 1 or len(t or "") < 1000]
    check_pieces(packing.pieces(tokens, length).collect(), want, length)
    windows = {r["sequence_id"]: (bytes(r["ids"]), r["pieces"]) for r in packing.windows(tokens, length).collect()}
    for p in packing.pieces(tokens, length).collect():
        ids, parts = windows[p["sequence_id"]]
        assert ids[p["offset"] * 4:(p["offset"] + p["length"]) * 4] == bytes(p["ids"])
        assert (p["doc_id"], p["start"], p["length"], p["offset"]) in [tuple(x) for x in parts]


def test_pieces_of_shared_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = [(r[0], library_ids(r[1])) for r in df.select("doc_id", "text").collect()]
    check_pieces(packing.pieces(packing.tokens(df.repartition(6), bpe.word_vocabulary())).collect(), want, 2048)


def test_nothing_to_pack(docs):
    tokens = packing.tokens(docs.where("false"), bpe.word_vocabulary())
    assert packing.pieces(tokens).count() == 0 and packing.windows(tokens).count() == 0


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_places_by_groups(spark, group):
    totals = [(p, p * 3 + 1) for p in range(0, 40, 2)]
    bases = packing.task_places(spark.createDataFrame(totals, "part long, n long"), group).collect()
    assert {r["part"]: r["base"] for r in bases} == {p: sum(n for q, n in totals if q < p) for p, _ in totals}


def test_batches_like_the_library():
    rnd = random.Random(1)
    bits = [*"aaAbBc'sSt ve.,!?1 2\n\tΣσßİéé_", "'ll", "'RE", "'s's", "ing", "the", "\x85", "\x1c", " ", "٣", "<|endoftext|>", "don't"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    encoder, small = (packing.BatchEncoder(bpe.Vocabulary(bpe.word_vocabulary()), store) for store in (10_000, 50))
    for k in range(0, len(texts), 100):
        some = texts[k:k + 100]
        ids, counts = encoder.encode(some)
        again, same = small.encode(some)
        assert ids.tolist() == again.tolist() and counts.tolist() == same.tolist()
        assert ids.tolist() == [i for t in some for i in library_ids(t)[:-1]] and counts.tolist() == [len(library_ids(t)) - 1 for t in some]
