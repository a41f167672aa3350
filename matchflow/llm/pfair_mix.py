"""Mixing sources to target weights by Pfair scheduling.

Native: DataFrame functions only. The documents of each source are cut into blocks of ``block_docs`` (in hashed order). Time is
counted in slots of one block, in periods of Q slots; a source has q of the Q slots. Given weights are taken as whole numbers q with Q their
sum, exactly, up to Q = EXACT_SLOTS; larger sums, and the default, are rounded to SLOTS slots (largest remainders, one at least), which then are the target. Its block j of a period is released at floor(j Q / q) and due by
ceil((j + 1) Q / q). Each slot goes to the released block with the earliest deadline (ties: the smaller source name).
The shares fill the period exactly, so every block meets its window and no source is ever a whole block ahead of or behind its weight.
At the end of a period all shares are whole, so one period's slots serve for all; a source that has run out leaves its
slots empty and the others keep their proportions. Every document has its slot: nothing is dropped or repeated.

Sources are a dimension table: shares and slots of one period are one row. Documents are ranked within their source from
(source, bucket) counts and a running sum in blocks, so a source with a third of all rows is spread over many tasks.

Weights: a mapping source -> weight (sources not in it get the smallest given), or by default the square root of each source's count.
Defined results: a NULL source is a source of its own, named NULL and first on ties. NULL ids are 0 in the hashed order.
Repeated rows have places of their own. NULL texts are ordinary documents. No rows in, no rows out. Extra columns
are ignored by ``schedule`` and kept by ``mixed``.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import Blocks, ordered
from .common import cut, scan

BLOCK_DOCS = 16
SLOTS = 1000
EXACT_SLOTS = 1 << 15
BUCKET_ROWS = 512
CARRY_BUCKETS = 4096

# one row: sources (array of s, n, w by name) and period; shares by largest remainder, one slot at least
SHARES = """transform(array_sort(transform(sources, x -> named_struct(
  'rest', -pmod(x.w * (period - size(sources)), total), 's', x.s, 'n', x.n, 'q', 1 + x.w * (period - size(sources)) div total))),
  (x, i) -> named_struct('s', x.s, 'n', x.n, 'q', x.q + if(i < spare, 1, 0)))"""
# earliest deadline first over one period: the source of each slot
PICKS = """aggregate(sequence(0, period - 1), named_struct('done', transform(shares, x -> 0), 'picks', cast(array() as array<int>)),
  (a, t) -> element_at(transform(array(array_min(filter(transform(a.done, (d, i) -> if(d < shares[i].q and d * period div shares[i].q <= t,
      named_struct('due', ((d + 1) * period + shares[i].q - 1) div shares[i].q, 'i', i), null)), c -> c is not null))),
    c -> named_struct('done', transform(a.done, (d, i) -> if(i = c.i, d + 1, d)), 'picks', array_append(a.picks, c.i))), 1),
  a -> a.picks)"""


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers of the same ratios, without a common divisor; each counts as the decimal number it is written as."""
    given = {name: Fraction(str(w)) for name, w in weights.items()}
    if min(given.values()) <= 0:
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in given.values()))
    numbers = {name: int(w * scale) for name, w in given.items()}
    common = math.gcd(*numbers.values())
    return {name: n // common for name, n in numbers.items()}


def plan(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, slots: int = SLOTS) -> DataFrame:
    """One row per source: __s, n (documents), q (slots a period), period, at (its slots in a period)."""
    counts = docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count("*").alias("n"))
    if weights:
        whole = whole_weights(weights)
        w = F.lit(min(whole.values()))
        for name, weight in whole.items():
            w = F.when(F.col("s") == name, F.lit(weight)).otherwise(w)
    else:
        w = F.floor(F.sqrt("n") * 1000)
    one = counts.agg(F.array_sort(F.collect_list(F.struct("s", "n", w.cast("long").alias("w")))).alias("sources")).where(F.size("sources") > 0)
    one = one.withColumn("total", F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["w"]))
    # weights of one's own that fit are the shares themselves: a period is as many slots as their sum
    exact = F.lit(bool(weights)) & (F.col("total") <= EXACT_SLOTS)
    one = one.withColumn("exact", exact).withColumn("period", F.when(exact, F.col("total")).otherwise(F.greatest(F.lit(slots), 4 * F.size("sources"))).cast("int"))
    one = one.withColumn("spare", F.expr("period - aggregate(sources, 0L, (a, x) -> a + 1 + x.w * (period - size(sources)) div total)"))
    one = one.withColumn("shares", F.when(F.col("exact"), F.expr("transform(sources, x -> named_struct('s', x.s, 'n', x.n, 'q', x.w))"))
                         .otherwise(F.array_sort(F.expr(SHARES)))).withColumn("picks", F.expr(PICKS))
    rows = one.select("period", "picks", F.posexplode("shares").alias("i", "x"))
    at = F.filter(F.transform("picks", lambda p, t: F.when(p == F.col("i"), t)), lambda t: t.isNotNull())
    return cut(rows.select(F.col("x.s").alias("__s"), F.col("x.n").alias("n"), F.col("x.q").cast("long").alias("q"),
                           F.col("period").cast("long").alias("period"), at.alias("at")))


def _bucket(doc_id: Column, buckets: int) -> Column:
    mixed_bits = (F.pmod(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(2 ** 31)) * F.lit(2654435761)) % F.lit(2 ** 32)
    return F.floor(mixed_bits * F.lit(buckets) / F.lit(2 ** 32)).cast("long")


def schedule_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", *, weights: dict[str, float] | None = None,
                  block_docs: int = BLOCK_DOCS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with __block, __release, __deadline, __slot and __place (inside the block)."""
    by_source = plan(docs, source, weights, slots)
    total = by_source.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_ROWS))
    keyed = docs.withColumns({"__s": F.col(source).cast("string"), "__b": _bucket(F.col(doc_id), buckets)})
    keyed = keyed.withColumn("__s", F.struct("__s"))  # a NULL name inside a struct is an ordinary key
    sizes = cut(keyed.groupBy("__s", "__b").agg(F.count("*").alias("__n")))
    ranked = ordered(sizes, ["__s"], ["__b"], Blocks.every(CARRY_BUCKETS), running={"__end": F.col("__n")})
    named = by_source.select(F.struct("__s").alias("__s"), F.col("q").alias("__q"), F.col("period").alias("__period"), F.col("at").alias("__at"))
    first = F.col("__end") - F.col("__n")
    low, high = F.floor(first / block_docs), F.floor((F.col("__end") - 1) / block_docs)
    own = F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda b: F.floor(b / F.col("__q")) * F.col("__period")
                      + F.get(F.col("__at"), (b % F.col("__q")).cast("int")))
    starts = ranked.join(named, "__s").select("__s", "__b", first.alias("__first"), "__q", "__period", own.alias("__own"))
    order = Window.partitionBy("__s", "__b").orderBy(F.col(doc_id).asc_nulls_first())
    rank = F.col("__first") + F.col("__r") - 1
    placed = keyed.withColumn("__r", F.row_number().over(order)).join(starts, ["__s", "__b"])
    placed = placed.withColumn("__rank", rank).withColumn("__block", F.floor(F.col("__rank") / block_docs))
    turn, lap = F.col("__block") % F.col("__q"), F.floor(F.col("__block") / F.col("__q")) * F.col("__period")
    return placed.select(
        *docs.columns, "__block", (lap + F.floor(turn * F.col("__period") / F.col("__q"))).alias("__release"),
        (lap + F.ceil((turn + 1) * F.col("__period") / F.col("__q"))).alias("__deadline"),
        F.get("__own", (F.col("__block") - F.floor(F.col("__first") / block_docs)).cast("int")).alias("__slot"),
        (F.col("__rank") % block_docs).cast("int").alias("__place"))


def schedule(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """(id, source, block, release, deadline, slot, place) of every document."""
    done = schedule_rows(docs.select(doc_id, source), doc_id, source, **how)
    return done.select(doc_id, source, *[F.col(f"__{c}").alias(c) for c in ("block", "release", "deadline", "slot", "place")])


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """All rows of ``docs`` in the order of the schedule: ranges of slots, sorted inside."""
    done = schedule_rows(docs, doc_id, source, **how)
    return done.repartitionByRange("__slot", "__place").sortWithinPartitions("__slot", "__place").select(*docs.columns)


def op5(spark, sf):
    return schedule(scan(spark, sf, "documents"))


OP5_SQL = """
WITH RECURSIVE counts AS (SELECT source AS s, count(*) AS n, floor(sqrt(count(*)) * 1000)::BIGINT AS w FROM documents GROUP BY source),
size AS (SELECT count(*) AS k, greatest(1000, 4 * count(*)) AS period, sum(w)::BIGINT AS total, sum(n)::BIGINT AS docs FROM counts),
whole AS (SELECT s, n, 1 + w * (period - k) // total AS q, w * (period - k) % total AS rest FROM counts, size),
ranked AS (SELECT s, n, q, row_number() OVER (ORDER BY rest DESC, s NULLS FIRST) AS place FROM whole),
shares AS (SELECT s, n, q + CASE WHEN place <= (SELECT any_value(period) FROM size) - (SELECT sum(q) FROM whole) THEN 1 ELSE 0 END AS q FROM ranked),
lists AS (SELECT list(q::BIGINT ORDER BY s NULLS FIRST) AS q, list(s ORDER BY s NULLS FIRST) AS s FROM shares),
edf AS (
  SELECT -1::BIGINT AS t, list_transform(q, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = best % 100000 THEN 1 ELSE 0 END), best % 100000
  FROM (SELECT t, done, list_min(list_filter(list_transform(done, lambda d, i:
               CASE WHEN d < q[i] AND d * period // q[i] <= t + 1 THEN ((d + 1) * period + q[i] - 1) // q[i] * 100000 + i END),
               lambda x: x IS NOT NULL)) AS best
        FROM edf, lists, size WHERE t + 1 < period)),
slots AS (SELECT lists.s[pick] AS s, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf, lists WHERE t >= 0),
hashed AS (SELECT doc_id, source, ((coalesce(doc_id, 0) % 2147483648) * 2654435761 % 4294967296) * greatest(1, (docs + 511) // 512) // 4294967296 AS b
           FROM documents, size),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY b, doc_id NULLS FIRST) - 1 AS r FROM hashed),
blocks AS (SELECT doc_id, source, r // 16 AS block, r % 16 AS place, shares.q, period
           FROM placed JOIN shares ON source IS NOT DISTINCT FROM shares.s, size)
SELECT doc_id, source, block, block // q * period + block % q * period // q AS release,
       block // q * period + ((block % q + 1) * period + q - 1) // q AS deadline,
       block // q * period + slots.t AS slot, place::INTEGER AS place
FROM blocks JOIN slots ON source IS NOT DISTINCT FROM slots.s AND block % q = slots.j"""

QUERIES = {"op5_pfair_mix": op5}
SQL = {"op5_pfair_mix": OP5_SQL}
