"""Chat formatting with relational operators: one formatted text per conversation and its loss mask.

The turns of a conversation are collected as structs, sorted, and folded by array aggregation: a turn of the same role as the one before goes on
in its frame, another one closes it and opens its own; the fold also lays the loss mask. Only Spark expressions are used.

Template: ``[SYS]text[/SYS]``, ``[INST]text[/INST]``, ``<s>text</s>`` for system, user and assistant, and
``[ROLE:name]text[/ROLE:name]`` for any other role. A further turn of the same role continues the open frame
with ``[+INST]`` and so on, so the turns can be told apart again. Inside texts and role names ``&``, ``<`` and
``[`` are written as entities, so no text can forge a mark and reading back is exact.

The loss mask is an array of (start, length) in code points of the formatted text, one per assistant turn.

Defined results: NULL text and NULL role are empty strings; NULL ids form one conversation; NULL turns come
first; equal turn numbers are ordered by role, then text; repeated rows are repeated turns. No rows in, no rows out.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scan

# role, mark name, bracket pair
FRAMES = (("system", "SYS", "[", "]"), ("user", "INST", "[", "]"), ("assistant", "s", "<", ">"))
LOSS_ROLE = "assistant"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
NAME_ENTITIES = (*ENTITIES, ("]", "&#93;"), (">", "&gt;"))


def escaped(c: Column, table=ENTITIES) -> Column:
    for raw, entity in table:
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def unescaped(c: Column, table=ENTITIES) -> Column:
    for raw, entity in reversed(table):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def _mark(role: Column, sign: str) -> Column:
    out = F.concat(F.lit(f"[{sign}ROLE:"), escaped(role, NAME_ENTITIES), F.lit("]"))
    for name, mark, left, right in FRAMES:
        out = F.when(role == name, F.lit(f"{left}{sign}{mark}{right}")).otherwise(out)
    return out


def formatted(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss_mask), one row per conversation: its sorted turns folded into frames, pieces and mask."""
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.struct(F.col(turn).alias("t"), r.alias("r"), x.alias("x"))
    turns = rows.groupBy(F.col(conv).alias("c")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    none = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("pieces"), F.lit(0).cast("long").alias("at"),
                    F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def add(now: Column, t: Column) -> Column:
        mark = (F.when(now["role"].isNull(), _mark(t["r"], "")).when(now["role"] == t["r"], _mark(t["r"], "+"))
                .otherwise(F.concat(_mark(now["role"], "/"), _mark(t["r"], ""))))
        body = escaped(t["x"])
        start, length = now["at"] + F.char_length(mark), F.char_length(body).cast("long")
        span = F.struct(start.alias("start"), length.alias("length"))
        return F.struct(t["r"].alias("role"), F.array_append(now["pieces"], F.concat(mark, body)).alias("pieces"), (start + length).alias("at"),
                        F.when(t["r"] == LOSS_ROLE, F.array_append(now["mask"], span)).otherwise(now["mask"]).alias("mask"))

    done = turns.select("c", F.aggregate("turns", none, add).alias("f"))
    return done.select(F.col("c").alias(conv), F.concat(F.array_join("f.pieces", ""), _mark(F.col("f.role"), "/")).alias("formatted"),
                       F.col("f.mask").alias("loss_mask"))


def read_back(text: Column) -> Column:
    """Array of (role, text), the turns a formatted text was made of."""
    marks = F.filter(F.split(text, r"[<\[]", -1), lambda _, i: i > 0)
    pairs = F.filter(F.transform(marks, lambda m: F.split(m, r"[>\]]", 2)), lambda p: ~p[0].startswith("/"))

    def role_of(name: Column) -> Column:
        bare = F.regexp_replace(name, r"^\+", "")
        out = unescaped(F.regexp_replace(bare, "^ROLE:", ""), NAME_ENTITIES)
        for role, mark, _, _ in FRAMES:
            out = F.when(bare == mark, F.lit(role)).otherwise(out)
        return out

    return F.transform(pairs, lambda p: F.struct(role_of(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def under_mask(text: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op6(spark, sf):
    rows = scan(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = formatted(rows.unionByName(probe)).withColumns(
        {"turns": read_back(F.col("formatted")), "learned": under_mask(F.col("formatted"), F.col("loss_mask"))})
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
                      F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same, lead(role) OVER w IS NOT DISTINCT FROM role AS goes_on
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3
        ELSE 7 + length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'), '>', '&gt;')) END AS mark,
        length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS body FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE WHEN same THEN mark + 1 ELSE mark END + CASE WHEN goes_on THEN 0 ELSE mark + 1 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""

QUERIES = {"op6_chat_format": op6}
SQL = {"op6_chat_format": OP6_SQL}
