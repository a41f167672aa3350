"""Merkle manifest of a table by slot pivots.

Every row is a leaf; the leaves of a group (a source) are a tree of ``FANOUT`` children a node, the roots of the groups are the leaves of one
more tree. A level is one aggregation: the children of a parent are spread over FANOUT slot columns by conditional aggregates, the columns
joined hash the parent, and the columns without a child's own, left and right of it, are its siblings. Way down again, the
siblings of a node are put before those of its parent, so a path is made once a parent and not once a leaf; only the last step makes one row
a leaf. Folding a leaf with its path gives back the root.

Places: rows are range-partitioned by group and order, so a group of any size is spread; counts per (group, partition) and their running
sum turn places in a partition into places in the group. The text is read once and not shuffled: leaves are hashed in the scan.

Hashing: sha256 in lower-case hex of the joined inputs, digests as hex text; values as ``-`` for NULL, else their UTF-8 byte count, ``:``
and the value.

Defined results: a NULL group is a group of its own, before all others; groups are ordered bytewise. NULLs of the order column come first; rows
equal in it are ordered by their leaves, so repeated rows have equal leaves and places next to each other. A lone leaf is the root of its
group, a lone group's root is the root. No rows in, no rows out. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, scan

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = [f"s{i}" for i in range(FANOUT)]


def encoded(value: Column) -> Column:
    """``-`` or byte count, colon and value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Written rows (with column ``g``) with ``pos``, their place in the group from 0, and ``n``, the size of the group."""
    sorted_ = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    line = cut(sorted_.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    counts = line.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(group).alias("n"))
    return line.join(counts, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _joined(slots: list[str]) -> str:
    # absent slots are NULL and left out
    return f"concat_ws('', {', '.join(f'{s}.hash' for s in slots)})" if slots else "''"


def parents(nodes: DataFrame) -> DataFrame:
    """One row per parent (g, pos, n: nodes of this level): its children, structs with their ``hash``, in slots s0, s1, ..."""
    child = f"struct({', '.join(c for c in nodes.columns if c not in ('g', 'pos', 'n'))})"
    spread = [F.expr(f"max(CASE WHEN pos % {FANOUT} = {i} THEN {child} END) AS {s}") for i, s in enumerate(SLOTS)]
    made = nodes.where("n > 1").groupBy("g", F.expr(f"pos div {FANOUT} AS at")).agg(F.expr(f"(first(n) + {FANOUT - 1}) div {FANOUT} AS n"), *spread)
    return made.withColumnRenamed("at", "pos")


def tree(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(root of each group with its ``depth``, parents of each level from the lowest). ``nodes``: g, pos, n, hash and what leaves carry."""
    most, levels, tops = nodes.agg(F.max("n")).first()[0] or 0, [], []
    while True:
        tops.append(nodes.where("n = 1").select("g", "hash", F.lit(len(levels)).alias("depth")))
        if most <= 1:
            return cut(reduce(DataFrame.union, tops)), levels
        levels.append(cut(parents(nodes)))
        nodes = levels[-1].select("g", "pos", "n", F.expr(f"sha2({_joined(SLOTS)}, 256) AS hash"))
        most = -(-most // FANOUT)


def _children(level: DataFrame, paths: DataFrame, carried: list[str]) -> DataFrame:
    """The children of a level's parents with their paths, own siblings first."""
    held = ", ".join(f"{{s}}.{c} AS {c}" for c in carried)
    own = ", ".join(f"CASE WHEN {s} IS NOT NULL THEN struct(pos * {FANOUT} + {i} AS pos, {'struct(' + held.format(s=s) + ')' if carried else 'NULL'} AS c, "
                    f"concat(array(struct({_joined(SLOTS[:i])} AS l, {_joined(SLOTS[i + 1:])} AS r)), path) AS path) END" for i, s in enumerate(SLOTS))
    found = level.join(paths, ["g", "pos"]).select("g", F.expr(f"explode(array_compact(array({own}))) AS o"))
    return found.select("g", "o.pos", *[F.col(f"o.c.{c}").alias(c) for c in carried], "o.path")


def leaf_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """What the leaves carry with their whole paths: arrays of (l, r), the siblings left and right of a node, level by level.
    ``tops``: g, depth and the path above each group's root."""
    top = tops.select("g", F.lit(0).cast("long").alias("pos"), "path", "depth")
    paths = top.where("false").drop("depth")
    for k in reversed(range(len(levels))):
        paths = paths.union(top.where(F.col("depth") == k + 1).drop("depth"))
        if k:
            paths = cut(_children(levels[k], paths, []))
    alone = nodes.where("n = 1").join(top.where("depth = 0").select("g", "path"), "g").select("g", *carried, "path")
    return alone.union(_children(levels[0], paths, carried).select("g", *carried, "path")) if levels else alone


def folded(first: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to. A node without siblings is hashed alone; nothing above the root is in the path."""
    return F.aggregate(path, first, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(docs: DataFrame, leaf_hash: Column, group: str = "source", order: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per leaf: the order column, ``leaf``, the ``carried`` columns, ``subroot``, ``root`` and ``path``."""
    carried = carried or {}
    name = F.coalesce(F.concat(F.lit(">"), F.col(group).cast("string")), F.lit(""))
    extra = {f"c_{k}": v for k, v in carried.items()}
    rows = docs.select(name.alias("g"), F.col(order).alias("key"), leaf_hash.alias("hash"), *[v.alias(k) for k, v in extra.items()])
    nodes = cut(ranked(rows, ["key", "hash"]))
    subroots, levels = tree(nodes)
    above = cut(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "hash", "depth"), ["name"]))
    root, upper = tree(above)
    paths = leaf_paths(above, upper, root.withColumn("path", F.array().cast("array<struct<l:string,r:string>>")), ["name", "hash", "depth"])
    tops = cut(paths.select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "depth", "path"))
    leaves = leaf_paths(nodes, levels, tops, ["key", "hash", *extra])
    out = leaves.join(tops.select("g", "subroot"), "g").withColumn("root", root.select("hash").scalar())
    return out.select(F.col("key").alias(order), F.col("hash").alias("leaf"), *[F.col(f"c_{k}").alias(k) for k in carried], "subroot", "root", "path")


def op12(spark, sf):
    docs = scan(spark, sf, "documents")
    values = {c: F.col(c) for c in FIELDS}
    changed = leaf([*{**values, "text": ascii_lower(F.col("text"))}.values()])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    out = manifest(docs, leaf([*values.values()]), carried={"tampered": tampered})
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


# levels by recursion: nodes of the trees of the sources, then of the tree of their roots
OP12_SQL = f"""
WITH RECURSIVE bits AS (SELECT [list_reduce([x] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) FOR x IN range(256)] AS t),
docs AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS other,
  xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, bits),
base AS (SELECT *, source IS NULL AS nil, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n FROM docs),
low AS (SELECT source, 0 AS lv, pos, n, leaf AS h FROM base
  UNION ALL SELECT source, lv + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, lv, pos // 16),
subs AS (SELECT source, lv AS depth, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lv, place AS pos, n, h FROM subs
  UNION ALL SELECT lv + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lv, pos // 16),
top AS (SELECT h AS root FROM high WHERE n = 1),
beside AS (SELECT FALSE AS up, source, lv, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM low WHERE n > 1
    WINDOW w AS (PARTITION BY source, lv, pos // 16 ORDER BY pos)
  UNION ALL SELECT TRUE, NULL, lv, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') FROM high WHERE n > 1
    WINDOW w AS (PARTITION BY lv, pos // 16 ORDER BY pos)),
start AS (SELECT row_number() OVER () AS r_id, doc_id, leaf, b.source, b.pos, s.depth, s.place, s.h AS subroot, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS used
  FROM base b JOIN subs s ON b.source IS NOT DISTINCT FROM s.source),
walk AS (SELECT r_id, 0 AS step, used AS h, '' AS beside FROM start
  UNION ALL SELECT w.r_id, w.step + 1, sha256(x.l || w.h || x.r), w.beside || x.l || x.r FROM walk w JOIN start s USING (r_id)
  JOIN beside x ON x.up = (w.step >= s.depth) AND (x.up OR x.source IS NOT DISTINCT FROM s.source)
    AND x.lv = CASE WHEN x.up THEN w.step - s.depth ELSE w.step END
    AND x.pos = CASE WHEN x.up THEN s.place // (16 ** (w.step - s.depth))::BIGINT ELSE s.pos // (16 ** w.step)::BIGINT END),
ends AS (SELECT r_id, arg_max(h, step) AS folded_root, sha256(arg_max(beside, step)) AS proof_sha256 FROM walk GROUP BY r_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM start JOIN ends USING (r_id), top"""

QUERIES = {"op12_merkle": op12}
SQL = {"op12_merkle": OP12_SQL}
