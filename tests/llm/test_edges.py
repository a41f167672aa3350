"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every corpus operator."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchflow.llm import (bitslice_topk, bpe, chat_format, exact_dedup, lang_crf, line_dedup, near_dedup, pfair_mix, pii_crf,
                           secret_scan)

LONG = " ".join(f"word{i} stands here" for i in range(12_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
ROWS = [
    (1, WORDS, "en", "a", "mine"), (2, WORDS.upper(), "en", "a", "mine"), (2, WORDS.upper(), "en", "a", "mine"),
    (3, None, None, None, None), (4, "", "de", "b", "mine"), (None, "a text without an id\nand two lines", "en", "b", "mine"),
    (5, LONG, "en", "a", "mine"), (6, "x" * 300_000, None, "b", "mine"), (7, "12345 !!! \n\n ٣", "en", None, "mine"),
    (8, WORDS, None, "a", "mine"), (3, "other text of the id three", "en", "c", "mine")]
CLASH = ["spans", "ids", "decoded", "lang_pred", "score", "keep", "n_lines", "kept", "label", "node", "row", "id", "v", "name"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, own string")
    return plain.withColumns({c: F.lit(f"mine {c}") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_pii(docs, nothing):
    out = pii_crf.marked(docs)
    assert out.count() == len(ROWS) and set(out.columns) == set(docs.columns)
    assert pii_crf.marked(nothing).count() == 0


def test_secrets(docs, nothing):
    out = secret_scan.scanned(docs)
    assert out.count() == len(ROWS) and set(out.columns) == set(docs.columns)
    assert out.agg(F.sum(F.size("spans"))).first()[0] == 0
    assert secret_scan.scanned(nothing).count() == 0


def test_bpe(docs, nothing):
    out = bpe.encoded(docs, bpe.word_vocabulary())
    assert set(out.columns) == set(docs.columns) and out.count() == len(ROWS)
    assert {len(r[0]) for r in out.where("text IS NULL OR text = ''").select("ids").collect()} == {0}
    assert bpe.encoded(nothing, bpe.word_vocabulary()).count() == 0
    odd = docs.sparkSession.createDataFrame([([320, None, -1, 10 ** 6],), (None,), ([],)], "ids array<int>")
    assert sorted(r[0] for r in odd.select(bpe.decode(F.col("ids"), bpe.word_vocabulary())).collect())[:2] == ["", ""]


@pytest.mark.parametrize("bits", [128, 2])
def test_exact(docs, nothing, bits):
    got = rows(exact_dedup.named_groups(docs, bits=bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert len(got) == len(ROWS)
    fox = [g for g in got if g[4] == sha(WORDS)]
    assert {g[1:3] for g in fox} == {(8, 4)} and sum(g[3] for g in fox) == 1
    assert {g[:4] for g in got if g[4] == sha("")} == {(3, 4, 2, False), (4, 4, 2, True)}
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=repr) == sorted([8, 4, None, 5, 6, 7, 3], key=repr)
    assert exact_dedup.deduplicated(nothing).count() == 0


def test_exact_blocks(spark):
    texts = ["ab" * 500, "AB" * 500, "ab" * 499 + "aa", "ab" * 500 + "a", "ba" * 500, "", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (1, 7, 64, 4096):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.named_groups(df, size=size).collect()}
        assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1)}


def test_lines(spark, docs, nothing):
    out = line_dedup.without_repeats(docs)
    assert out.count() == len(ROWS)
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in out.collect()}
    # the same line in documents 1, 2 (twice a row) and 8
    assert {(1, 1, 1), (2, 1, 1), (8, 1, 0), (3, 1, 0), (4, 1, 0), (7, 3, 0), (None, 2, 0)} <= got
    assert line_dedup.keep_bitmaps(docs).count() == len(ROWS)
    assert line_dedup.keep_bitmaps(nothing).count() == 0
    keep = {r["doc_id"]: [tuple(k) for k in r["keep"]] for r in line_dedup.keep_bitmaps(docs).collect() if r["doc_id"] != 3}
    assert keep[1] == [] and keep[8] == [(0, 1)] and keep[7] == [(0, 3)]


def test_languages(docs, nothing):
    out = lang_crf.identified(docs)
    assert set(out.columns) == set(docs.columns) | {"switches"} and out.count() == len(ROWS)
    und = {r["doc_id"] for r in out.where("lang_pred = 'und'").collect()}
    assert und == {3, 4} or und == {3, 4, 7}
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert lang_crf.identified(nothing).count() == 0


def test_mixing(docs, nothing):
    out = pfair_mix.schedule(docs, block_docs=2)
    assert out.count() == len(ROWS)
    assert out.where("slot < release OR slot >= deadline").count() == 0
    assert out.select("slot", "place").distinct().count() == len(ROWS)
    assert rows(pfair_mix.mixed(docs), "doc_id", "own") == rows(docs, "doc_id", "own")
    assert pfair_mix.mixed(nothing).count() == 0


def test_near(docs, nothing):
    got = {(r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.classes(docs).collect()}
    assert {(1, 1, 4), (2, 1, 4), (8, 1, 4), (4, 4, 1), (5, 5, 1), (6, 6, 1), (None, None, 1)} <= got
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert near_dedup.classes(nothing).count() == 0


def test_top_k(spark):
    vectors = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
               (6, [0.25]), (7, []), (8, [-1.0, -0.5]), (None, [1.0, 1.0]), (9, [1.0, 0.5]), (9, [1.0, 0.5])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    good = bitslice_topk.usable(table)
    got = [tuple(r) for r in bitslice_topk.top_k(good, good.where("vec_id = 0"), 5).orderBy("rank").collect()]
    full = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, full), (0, 2, 9, full), (0, 3, 9, full), (0, 4, 6, 1024 * 256), (0, 5, 7, 0)]
    none = good.where("false")
    assert bitslice_topk.top_k(none, none).count() == 0 and bitslice_topk.top_k(good, none).count() == 0


def test_chat(spark):
    said = [(1, 0, "system", "s"), (1, 1, "user", "a[b]<c>&amp;\\"), (1, 2, "user", None), (1, 3, "assistant", "x"), (1, 4, "assistant", "y"),
            (2, None, None, "first"), (2, 1, "to<o>l", "[/INST]</s>"), (2, 1, "to<o>l", "[/INST]</s>"), (None, 1, "assistant", ""), (3, 0, "user", "")]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat_format.formatted(table).withColumns({
        "turns": chat_format.read_back(F.col("formatted")), "learned": chat_format.under_mask(F.col("formatted"), F.col("loss_mask"))}).collect()}
    assert out[1]["formatted"] == "[SYS]s[/SYS][INST]a&#91;b]&lt;c>&amp;amp;\\[+INST][/INST]<s>x<+s>y</s>"
    assert [tuple(t) for t in out[1]["turns"]] == [("system", "s"), ("user", "a[b]<c>&amp;\\"), ("user", ""), ("assistant", "x"), ("assistant", "y")]
    assert out[1]["learned"] == "xy"
    assert [tuple(t) for t in out[2]["turns"]] == [("", "first"), ("to<o>l", "[/INST]</s>"), ("to<o>l", "[/INST]</s>")]
    assert [tuple(t) for t in out[None]["turns"]] == [("assistant", "")] and out[3]["learned"] == ""
    assert chat_format.formatted(table.where("false")).count() == 0


def test_pipeline(spark, docs, nothing):
    for table in (docs, nothing):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.cut(stage(spark, now, ""))
            assert now.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, now, "")
        assert last.count() == now.count()
    assert np.isfinite(1.0)
