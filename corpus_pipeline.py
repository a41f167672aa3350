"""A training corpus from raw documents: language, exact copies, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``docs``. Only decisions of the operators remove rows:

* ``language_id`` removes texts without a letter and texts in which no language has ``LEAST_SHARE`` of the words; its model learns from
  the labelled documents that are not held out. Without any such document nothing can be learned, and all documents stay.
* ``exact_dedup`` keeps the row with the largest id of equal texts (A-Z lower-cased).
* ``near_dedup`` keeps the row with the smallest id of each class of near copies.
* ``mix_sources`` keeps every row and writes them in the order of the Pfair schedule, so any run of whole blocks holds the target
  weights; sources that end early leave the others in their proportions.
* ``bpe`` encodes and decodes what is left.

Columns with names of the operators' results are kept as they are. Empty tables pass through every stage.
"""

from pyspark.sql import functions as F

from matchflow.lineage import cut
from matchflow.llm import bpe, exact_dedup, lang_crf, near_dedup, pfair_mix

LEAST_SHARE = 0.35
FOUND = "__language"


def language_id(spark, docs, sf_dir):
    model = lang_crf.fitted(docs)
    if model is None:  # nothing to learn from: nothing is known about any text
        return docs
    found = lang_crf.small_batches(docs).withColumn(FOUND, lang_crf.languages(F.col("text"), model))
    fits = (F.col(f"{FOUND}.lang") != lang_crf.UNKNOWN) & (F.col(f"{FOUND}.score") >= LEAST_SHARE)
    return found.where(fits).select(*docs.columns)


def exact(spark, docs, sf_dir):
    return exact_dedup.deduplicated(docs)


def near(spark, docs, sf_dir):
    return near_dedup.deduplicated(docs)


def mix_sources(spark, docs, sf_dir):
    return pfair_mix.mixed(docs)


def encode(spark, docs, sf_dir):
    return bpe.digests(docs, bpe.word_vocabulary())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
