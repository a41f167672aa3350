"""Operators against plain versions, exact round trips and held-out accuracy."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from matchflow.llm import bitslice_topk, bpe, lang_crf, near_dedup, pfair_mix, pii_crf, registry, secret_scan
from matchflow.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    ok, text, _ = compare(spark, duck(SF), SF, registry.QUERIES[name], registry.SQL[name])
    assert ok, text


@pytest.fixture(scope="module")
def texts(spark):
    return [(r[0], r[1] or "", r[2]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def test_bpe_like_the_library(spark, texts):
    from tokenizers import Tokenizer
    path = bpe.word_vocabulary()
    library = Tokenizer.from_file(path)
    rnd = random.Random(1)
    bits = [*"aaAbBc'sSt ve.,!?1 2\n\tΣσßİéé", "<|endoftext|>", "<|startoftext|>", "'ll", "ing", "the", "\x85", "\x1c"]
    some = [t for _, t, _ in texts] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in bpe.encoded(df, path).collect():
        want = library.encode(some[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_bpe_small_store():
    v = bpe.Vocabulary(bpe.word_vocabulary())
    some = ["the cat sat on the mat", "a dog ran", "the cat ran again"]
    wide, narrow = bpe.Encoder(v), bpe.Encoder(v, store=4)
    for t in some:
        assert wide.encode([t])[0].tolist() == narrow.encode([t])[0].tolist()
    v.whole_rounds = False
    assert bpe.Encoder(v).encode(some)[0].tolist() == bpe.Encoder(bpe.Vocabulary(bpe.word_vocabulary())).encode(some)[0].tolist()


def plain_secrets(text):
    either = "".join
    words = "|".join(either(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    words += "|" + either(f"[{c.upper()}{c}]" for c in "api") + "_?" + either(f"[{c.upper()}{c}]" for c in "key")
    rules = (("assign", f"({words})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    found = [(m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(rules) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return [(rules[i][0], a, b) for a, i, b in sorted(found)]


def test_secrets(texts):
    rnd = random.Random(2)
    bits = ["token", "TOKEN", "Secret", "api_key", "apikey", "pass", "word", "wd", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCD1234EFGH5678",
            "0123456789abcdef", "ſecret", "toKen", "é"]
    some = [t for _, t, _ in texts] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(2000)]
    for text, found in zip(some, secret_scan.scan_texts(some)):
        assert [(s["kind"], s["start"], s["end"]) for s in found if s["base"]] == plain_secrets(text)


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_index_never_misses(rule):
    """Every text that a rule's expression finds is among the candidates of its trigram query."""
    rnd = random.Random(3)
    bits = ["token=abcdef", "passwd: 123456", "AKIA" + "A1" * 9, "0a" * 14, "ghp_" + "a1" * 20, "xoxb-" + "1" * 12, "AIza" + "x" * 35, "sk_live_" + "z" * 20,
            "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJ9.eyJzdWIiOiIx.abcdefghij", "noise ", "\n"]
    some = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 3))) for _ in range(300)]
    query = secret_scan.trigram_query(rule.pattern)
    index = secret_scan.Index(sorted(secret_scan._named(query)))
    index.build([t.encode() for t in some])
    assert {i for i, t in enumerate(some) if re.search(rule.pattern, t)} <= set(index.find(query).tolist())


def plain_pii(text):
    def digits(s):
        return "".join(c for c in s if c in "0123456789")
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m.group())][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return [(pii_crf.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_pii_base(texts):
    rnd = random.Random(3)
    bits = [".", "@", "a.b", "x", "1", "25", "255", "256", "4111 1111 1111 1111", "4111-1111", "+", "(", ")", "-", " ", "  ", "_", "%", "٣", "é",
            "192.168.1.1", "+49 30 1234567", "123456789"]
    some = [t for _, t, _ in texts] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for text, found in zip(some, pii_crf.find(some, pii_crf.prior())):
        assert [(s["kind"], s["start"], s["end"]) for s in found if s["base"]] == plain_pii(text)


def test_pii_skip_links(texts):
    w = pii_crf.fit(pii_crf.graph_of([t for _, t, _ in texts]))
    text = "Call +1 (234) 567-8901 now. " + "filler " * 200 + "or 1 234 567 8901; the order 7654321999."
    added = [(s["kind"], text[s["start"]:s["end"]]) for s in pii_crf.find([text], w)[0] if not s["base"]]
    assert added == [("phone", "1 234 567 8901")]
    assert not pii_crf.find(["order 7654321999 and 12345678901"], w)[0]


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(0)
    unary, links = rng.normal(size=(5, 3)), np.array([(0, 1), (1, 2), (1, 3), (3, 4)])
    pair = rng.normal(size=(4, 3, 3))
    p = np.zeros((5, 3))
    for labels in itertools.product(range(3), repeat=5):
        e = np.exp(sum(unary[i, lab] for i, lab in enumerate(labels)) + sum(pair[k, labels[a], labels[b]] for k, (a, b) in enumerate(links)))
        for i, lab in enumerate(labels):
            p[i, lab] += e
    assert np.allclose(pii_crf.beliefs(unary, links, pair, rounds=200), p / p.sum(1, keepdims=True), atol=1e-3)


def test_forward_backward():
    rng = np.random.default_rng(0)
    lengths, logp, steps = np.array([1, 0, 70, 129, 100]), rng.normal(size=(300, 3)), rng.normal(size=(3, 3))
    want, at = [], 0
    for n in lengths:
        e, a = np.exp(logp[at:at + n]), np.exp(steps)
        ahead, v = [], None
        for t in range(n):
            v = e[t] if t == 0 else (v @ a) * e[t]
            v = v / v.sum()
            ahead.append(v)
        back, v = [None] * n, np.ones(3)
        for t in range(n - 1, -1, -1):
            back[t] = v
            v = a @ (e[t] * v)
            v = v / v.sum()
        want += [x * y / (x * y).sum() for x, y in zip(ahead, back)]
        at += n
    assert np.allclose(lang_crf.marginals(logp, lengths, steps), want)


def test_language_accuracy(texts):
    fit = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 5]
    rest = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 5 == 0]
    model = lang_crf.fit([t for _, t, _ in fit], [lang for _, _, lang in fit])
    labeller = lang_crf.Labeller(model)
    found = labeller.documents([t for _, t, _ in rest])
    right = sum(f["lang"] == lang for f, (_, _, lang) in zip(found, rest))
    assert right / len(rest) > 0.95
    one, other = (next(t for _, t, lang in rest if lang == x)[:400] for x in ("en", "fr"))
    p, n = labeller.word_labels([one + " " + other])
    half = len(lang_crf.words_of(one))
    labels = [model.labels[i] for i in p.argmax(1)]
    assert collections.Counter(labels[:half]).most_common(1)[0][0] == "en" and collections.Counter(labels[half:]).most_common(1)[0][0] == "fr"


def test_bit_slices():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n, d, size = int(rng.integers(1, 300)), int(rng.integers(1, 9)), 10 ** int(rng.integers(0, 4))
        rows = np.floor(rng.normal(size=(n, d)) * size).astype(np.int64)
        if trial % 3 == 0:
            rows[:n // 2] = rows[0]
        ids = rng.permutation(n * 2)[:n].astype(np.int64)
        asked = rng.choice(n, min(n, 5), False)
        low, slices = bitslice_topk.sliced(rows)
        for i, found, score in bitslice_topk.search(ids, low, slices, ids[asked], rows[asked], 10, 3, 3):
            true, other = rows @ rows[asked[i]], ids != ids[asked[i]]
            order = np.lexsort((ids[other], -true[other]))[:10]
            assert (ids[other][order] == found).all() and (true[other][order] == score).all()


def test_mixing_deviation(spark):
    counts = {"a": 500, "b": 130, "c": 61, None: 9}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    plan = {r["__s"]: (r["q"], r["period"]) for r in pfair_mix.plan(df).collect()}
    assert sum(q for q, _ in plan.values()) == 1000
    blocks = pfair_mix.schedule(df, block_docs=4).select("source", "block", "release", "deadline", "slot").distinct().collect()
    assert len({b["slot"] for b in blocks}) == len(blocks)
    assert all(b["release"] <= b["slot"] < b["deadline"] for b in blocks)
    taken = collections.Counter()
    size = {s: -(-n // 4) for s, n in counts.items()}
    for b in sorted(blocks, key=lambda b: b["slot"]):
        for s, (q, period) in plan.items():
            if taken[s] < size[s]:
                assert abs(taken[s] - b["slot"] * q / period) < 1
        taken[b["source"]] += 1
    weighted = {r["__s"]: r["q"] for r in pfair_mix.plan(df, weights={"a": 1, "b": 2, "c": 1}).collect()}
    assert weighted["b"] > 1.9 * weighted["a"] and weighted["a"] == weighted["c"] == weighted[None]


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    label = {x: x for link in links for x in link}
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == label


def test_near_classes(spark):
    """Small texts: a family of near copies around a base, more than a small group holds, a second base and lone texts."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base, second = [word() for _ in range(200)], [word() for _ in range(150)]
    docs = [base, second]
    for source, n, most in ((base, 60, 9), (second, 10, 4)):
        for _ in range(n):
            copy = list(source)
            for _ in range(rnd.randint(0, most)):
                copy[rnd.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [[word() for _ in range(rnd.randint(1, 60))] for _ in range(40)]
    docs += [base, docs[5]]
    texts = [" ".join(d) for d in docs]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, df = [], np.zeros(1 << near_dedup.DF_BITS, np.int64)
    for t in texts:
        a, c, _ = near_dedup.shingle_sets([t])
        sets.append((a, c))
        df[np.unique(near_dedup._bucket(a))] += 1
    idf = near_dedup.idf_of(df, len(texts))
    label = list(range(len(texts)))
    links = []
    for (i, (a, ca)), (j, (b, cb)) in itertools.combinations(enumerate(sets), 2):
        if near_dedup.weighted_jaccard(a, ca * idf[near_dedup._bucket(a)].astype(float), b, cb * idf[near_dedup._bucket(b)].astype(float)) >= 0.8:
            links.append((i, j))
    for _ in range(50):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label))


def test_weights_follow_frequency():
    df = np.array([1, 10, 1000])
    assert (np.diff(near_dedup.idf_of(df, 1000)) < 0).all()
    a, c, n = near_dedup.shingle_sets(["a b c d e a b c d e", "x", None, "..."])
    assert n.tolist() == [5, 1, 0, 0] and sorted(c[:5].tolist()) == [1, 1, 1, 1, 2]


def test_every_query_reads_its_table(spark):
    for name, query in registry.QUERIES.items():
        table = "embeddings" if name.startswith("op2") else "conversations" if name.startswith("op6") else "documents"
        if name in ("op1_pii", "op3_bpe", "op7_lang_id", "op9_secret_scan"):
            assert query(spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
            assert query(spark, SF).select(F.countDistinct("doc_id")).first()[0] > 0
