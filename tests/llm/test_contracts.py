"""Exact target weights, pair marginals, overlaps in long texts, clashing names, and the pipeline's contents."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchflow.llm import bpe, common, lang_crf, line_dedup, pfair_mix, pii_crf
from test_near_families import plain_classes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("weights", [{"a": 10000, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 7, "b": 3.5, "c": 1}])
def test_less_than_a_block_from_the_true_weights(spark, weights):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate("abc" * 3)], "doc_id long, source string")
    plan = {r["__s"]: r for r in pfair_mix.plan(docs, weights=weights).collect()}
    total, period = sum(weights.values()), plan["a"]["period"]
    for s, w in weights.items():
        assert plan[s]["q"] / period == pytest.approx(w / total, rel=1e-12)
        at = np.array(plan[s]["at"])
        got = np.cumsum(np.isin(np.arange(period), at))
        # whole shares at the end of a period, so the same holds in each of any number of periods
        assert got[-1] == plan[s]["q"] and (np.abs(got - np.arange(1, period + 1) * w / total) < 1).all()
    laps = pfair_mix.schedule(docs, weights=weights, block_docs=1)
    assert laps.where("slot < release OR slot >= deadline").count() == 0 and laps.select("slot").distinct().count() == 9


def test_names_of_the_schedule_may_clash(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(50)], "doc_id long, source string, own long")
    docs = docs.withColumns({c: F.col("own") for c in ("period", "q", "at", "n", "slot", "place", "block", "exact", "total")})
    out = pfair_mix.mixed(docs, block_docs=4)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_line_dedup_keeps_a_column_named_dropped(spark):
    line = "a line of more than twenty characters"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", i * 10) for i in range(4)], "doc_id long, text string, dropped long")
    out = {r["doc_id"]: (r["dropped"], r["n_dropped"], r["kept_text"]) for r in line_dedup.without_repeats(docs).collect()}
    assert out == {**{i: (i * 10, 1, f"own {i}") for i in range(3)}, 3: (30, 0, f"{line}\nown 3")}


def test_pair_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    for n, labels in ((2, 3), (6, 3), (5, 2)):
        logp, steps = rng.normal(0, 2, (n, labels)), rng.normal(0, 1.5, (labels, labels))
        want = np.zeros((n - 1, labels, labels))
        for path in itertools.product(range(labels), repeat=n):
            weight = np.exp(sum(logp[t, y] for t, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
            for t in range(n - 1):
                want[t, path[t], path[t + 1]] += weight
        want /= want.sum((1, 2), keepdims=True)
        for block in (2, 64):
            # a second chain beside it changes nothing
            both, lengths = np.concatenate([logp, logp[:2]]), np.array([n, 2])
            p, ahead = lang_crf.messages(both, lengths, steps, block)
            assert np.allclose(lang_crf.pair_marginals(p, ahead, steps, np.arange(1, n)), want, atol=1e-9)


def test_nothing_to_learn(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here", None), (2, None, None), (3, "", None)], "doc_id long, text string, lang string")
    docs = docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_crf.op7(spark, str(tmp_path)).collect()} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert corpus_pipeline.language_id(spark, docs, "").count() == 3
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), (F.col("id") % 200).cast("string").alias("lang"))
    with pytest.raises(ValueError):
        lang_crf.fitted(many)


def test_overlaps():
    rnd = random.Random(2)
    for _ in range(300):
        spans = [(a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 12)))]
        taken = pii_crf.Taken(spans)
        for a in range(0, 70, 3):
            b = a + rnd.randint(1, 8)
            assert taken.overlaps(a, b) == any(x < b and a < y for x, y in spans)


def plain_signs(text):
    """Tokens around @ as they were found before signs were remembered."""
    out, at = [], text.find("@")
    while at >= 0:
        left = at
        while left > 0 and not (text[left - 1].isspace() or text[left - 1] in "<>()[]{},;:\"'"):
            left -= 1
        m = pii_crf.AT_TOKEN.match(text, left)
        if m and m.end() - left > 5:
            out.append((left, m.end()))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    return out


def test_signs_of_one_token():
    rnd = random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice(["@", "@", "ab", "c.d", " ", ",", "-", "x1"]) for _ in range(rnd.randint(0, 14)))
        base = {(a, b) for _, a, b in pii_crf.base_spans(text)[0]}
        want = [s for s in plain_signs(text) if not any(x < s[1] and s[0] < y for x, y in base)]
        assert sorted((a, b) for a, b, label, _ in pii_crf.nodes_of(text) if label == -1 and "@" in text[a:b]) == sorted(want), text


@pytest.mark.parametrize("piece", ["user{0}@mail.example and foo{0}@bar ", "10.0.0.1   10.0.0.2   192.168.1.77   4.4.4.4 ", "@", "a@b.c,"])
def test_long_texts_of_many_spans(piece):
    text = "".join(piece.format(i) for i in range((1 << 20) // len(piece)))
    start = time.perf_counter()
    pii_crf.nodes_of(text)
    assert time.perf_counter() - start < 20  # the square of the spans takes minutes


def test_steps_are_removed(spark):
    steps = common.Steps(spark)
    one, two, kept = steps(spark.range(3)), steps(spark.range(4)), steps.keep(spark.range(5))
    before = steps.made()[:1]
    steps.clear(before)
    with pytest.raises(Exception):
        one.count()
    assert two.count() == 4 and kept.count() == 5
    steps.remove()
    with pytest.raises(Exception):
        kept.count()


def test_pipeline_contents(spark):
    """The whole pipeline against its stages one after the other in plain Python; only the language model is taken as it is."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.word_vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = lang_crf.identified(docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in named if r["lang_pred"] != lang_crf.UNKNOWN and r["score"] >= corpus_pipeline.LEAST_SHARE]
    assert 0.8 * len(named) < len(rows) <= len(named)
    last = {}
    for i, text in sorted(rows):
        last[re.sub("[A-Z]", lambda m: m.group().lower(), text)] = (i, text)
    rows = sorted(last.values())
    label = plain_classes([t for _, t in rows])
    rows = [row for k, row in enumerate(rows) if label[k] == k]
    want = set()
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want
