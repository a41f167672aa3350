"""Line dedup: range-partitioned line hashes, first occurrences in stream order, keep bitmaps per document.

Native: DataFrame functions only. Each line longer than ``min_chars`` becomes a 128-bit hash. Hashes are
range-partitioned on (hash, document) and sorted by (hash, document, position), so a line shared by a third of all
documents is spread over many tasks; each task streams the first occurrence per document and sends one
row per hash on. Results are run-length bitmaps of kept lines; text is only touched when they are applied.

Defined results: NULL text is an empty text, which is one empty line. A NULL id is one document that sorts
before all others. Repeated rows of one id are one document: their lines are counted once and share the
decision, every row is returned. No rows in, no rows out. Extra columns are ignored by ``keep_bitmaps`` and
kept by ``without_repeats``; a clashing name of theirs is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, scan

BLANKS = " \t\n\x0b\x0c\r"
LOWEST = -(2 ** 63)
ROW = ["__d", "__v"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"__d": F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)),
                             "__v": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(__d, __v, pos, h1, h2) of every line whose key has at least ``min_chars`` code points."""
    rows = _keyed(docs, doc_id, text).select(*ROW, F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    key = ascii_lower(F.col("key"))
    return (rows.select(*ROW, "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= min_chars)
            .select(*ROW, "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(20), key).alias("h2")))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_chars: int = 20,
                  min_docs: int = 3) -> DataFrame:
    """(__d, __v, dropped): the sorted line numbers that a document loses; documents that lose none are absent."""
    lines = cut(line_hashes(docs, doc_id, text, min_chars))
    stream = lines.repartitionByRange("h1", "h2", "__d").sortWithinPartitions("h1", "h2", "__d", "pos")
    first = Window.partitionBy("h1", "h2", "__d").orderBy("pos")
    firsts = stream.select("h1", "h2", "__d", "pos").withColumn("n", F.row_number().over(first)).where("n = 1")
    shared = cut(firsts.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("__d").alias("keeper"))
                 .where(F.col("docs") >= min_docs).select("h1", "h2", "keeper"))
    lost = lines.join(shared, ["h1", "h2"]).where(F.col("__d") < F.col("keeper"))
    return lost.groupBy(*ROW).agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """Run-length keep bitmap: array of (first, length) of kept lines."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines.cast("int")))
    runs = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(
        (edges[i - 1] + 1).alias("first"), (edges[i] - edges[i - 1] - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def _decided(docs: DataFrame, doc_id: str, text: str, **rules) -> DataFrame:
    lost = dropped_lines(docs, doc_id, text, **rules).withColumnRenamed("dropped", "__dropped")
    none = F.array().cast("array<int>")
    return (_keyed(docs, doc_id, text).join(lost, ROW, "left")
            .withColumn("__dropped", F.coalesce("__dropped", none)))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """Per row of ``docs``: its id, ``n_lines``, ``n_dropped`` and ``keep``, the run-length bitmap of kept lines."""
    slim = docs.select(doc_id, text)
    lost = dropped_lines(slim, doc_id, text, **rules)
    sized = _keyed(slim, doc_id, text).select(doc_id, *ROW, F.size(_lines(F.col(text))).alias("n_lines"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return sized.join(lost, ROW, "left").select(
        doc_id, F.col("n_lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"),
        kept_runs(dropped, F.col("n_lines")).alias("keep"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``keep`` and ``kept_text``: the bitmap applied to the text."""
    own = docs.drop("n_lines", "n_dropped", "keep", "kept_text")
    rows = _decided(own, doc_id, text, **rules).withColumn("__lines", _lines(F.col(text)))
    n = F.size("__lines")
    rows = rows.withColumn("keep", kept_runs(F.col("__dropped"), n))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(F.col("__lines"), r["first"] + 1, r["length"]))), "\n")
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.select(*own.columns, n.cast("long").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"), "keep",
                       F.when(F.size("__dropped") == 0, whole).otherwise(kept).alias("kept_text"))


def op8(spark, sf):
    docs = scan(spark, sf, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id < s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""

QUERIES = {"op8_line_dedup": op8}
SQL = {"op8_line_dedup": OP8_SQL}
