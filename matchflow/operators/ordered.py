"""Ordered (lag / lead / last value / running sum) computations that stay parallel inside one key.

A plain ``Window.partitionBy(match)`` puts a whole match, however large, into one task. Here the
order column is cut into blocks; the window runs inside (key, block), one small row per (key,
block) carries what crosses a border, and the carried value is joined back on (key, block), the
partitioning the window already has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
ROWS_PER_BLOCK = 1 << 18
MOST_CUTS = 4096
DECAY = 30


@dataclass(frozen=True)
class Blocks:
    """How the order column is cut: every ``width`` units, or at fixed ``cuts``, with ``parts`` of equal length between two of them."""

    width: float | None = None
    cuts: tuple = field(default=())
    parts: int = 1

    @staticmethod
    def every(width: float) -> "Blocks":
        """Fixed length, for data whose rate is bounded (tracking has a frame rate)."""
        return Blocks(width=float(width))

    @staticmethod
    def equal_depth(df: DataFrame, order: str, n: int | None = None) -> "Blocks":
        """Cuts that give every block about the same number of rows, whatever the density.

        One pass over one column; ``n`` follows the rows, so that a block holds about ``ROWS_PER_BLOCK`` of them however many there are, and is
        never below the session's parallelism. The driver and the plans hold at most ``MOST_CUTS`` numbers: beyond that the range between
        two neighbouring cuts, which all hold as many rows, is divided into parts of equal length.
        """
        v = F.col(order).cast("double")
        if n is None:
            n = max(-(-df.count() // ROWS_PER_BLOCK), 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        coarse, parts = min(n, MOST_CUTS), -(-n // MOST_CUTS)
        probs = [i / coarse for i in range(0 if parts > 1 else 1, coarse + (1 if parts > 1 else 0))]
        found = df.select(v.alias(order)).approxQuantile(order, probs, 1 / (4 * coarse))
        return Blocks(cuts=tuple(sorted(set(found))), parts=parts)

    def mark(self, df: DataFrame, order: str, name: str = BLOCK) -> DataFrame:
        if self.width:
            return df.withColumn(name, F.floor(F.col(order) / F.lit(self.width)).cast("long"))
        if not self.cuts:
            return df.withColumn(name, F.lit(0).cast("long"))
        splits = [float("-inf"), *self.cuts, float("inf")]
        src = name + "_v"
        marked = Bucketizer(splits=splits, inputCol=src, outputCol=name, handleInvalid="keep").transform(
            df.withColumn(src, F.col(order).cast("double")))
        if self.parts > 1:
            edges = F.array(*[F.lit(c) for c in (self.cuts[0], *self.cuts, self.cuts[-1])])
            at = F.col(name).cast("int")
            low, high = F.get(edges, at), F.get(edges, at + 1)
            part = F.floor((F.col(src) - low) / F.when(high > low, high - low) * self.parts)
            fine = F.least(F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)), F.lit(self.parts - 1))
            return marked.withColumn(name, F.col(name).cast("long") * self.parts + fine).drop(src)
        return marked.withColumn(name, F.col(name).cast("long")).drop(src)


def ordered(df: DataFrame, keys: list[str], order: list[str], blocks: Blocks, *,
            lag: dict[str, Column] | None = None, lead: dict[str, Column] | None = None,
            last: dict[str, Column] | None = None, following: dict[str, Column] | None = None,
            running: dict[str, Column] | None = None, keep_block: bool = False) -> DataFrame:
    """Add ordered columns within ``keys``, rows ordered by ``order`` (first column numeric).

    ``lag`` / ``lead``  value of the neighbouring row;
    ``last``            latest non-null value up to and including the row;
    ``following``       earliest non-null value from the row on;
    ``running``         running sum including the row.
    """
    lag, lead, last = lag or {}, lead or {}, last or {}
    following, running = following or {}, running or {}
    if BLOCK not in df.columns:
        df = blocks.mark(df, order[0])
    base = [*keys, BLOCK]
    key_of_row = F.struct(*[F.col(c) for c in order])
    up = Window.partitionBy(*base).orderBy(*[F.col(c).asc() for c in order])
    down = Window.partitionBy(*base).orderBy(*[F.col(c).desc() for c in order])
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    to_come = down.rowsBetween(Window.unboundedPreceding, 0)

    edge, carry, final = [], [], []
    border = Window.partitionBy(*keys).orderBy(F.col(BLOCK).asc())
    border_down = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc())
    before = border.rowsBetween(Window.unboundedPreceding, -1)
    after = border_down.rowsBetween(Window.unboundedPreceding, -1)
    inside = {}
    for name, e in lag.items():
        boxed = F.struct(e.alias("v"))
        inside[f"__i_{name}"] = F.lag(boxed).over(up)
        edge.append(F.max_by(boxed, key_of_row).alias(f"__e_{name}"))
        carry.append(F.lag(f"__e_{name}").over(border).alias(f"__c_{name}"))
        final.append((name, F.coalesce(f"__i_{name}", f"__c_{name}")["v"]))
    for name, e in lead.items():
        boxed = F.struct(e.alias("v"))
        inside[f"__i_{name}"] = F.lead(boxed).over(up)
        edge.append(F.min_by(boxed, key_of_row).alias(f"__e_{name}"))
        carry.append(F.lead(f"__e_{name}").over(border).alias(f"__c_{name}"))
        final.append((name, F.coalesce(f"__i_{name}", f"__c_{name}")["v"]))
    for name, e in last.items():
        inside[f"__i_{name}"] = F.last(e, ignorenulls=True).over(so_far)
        edge.append(F.max_by(e, F.when(e.isNotNull(), key_of_row)).alias(f"__e_{name}"))
        carry.append(F.last(f"__e_{name}", ignorenulls=True).over(before).alias(f"__c_{name}"))
        final.append((name, F.coalesce(f"__i_{name}", f"__c_{name}")))
    for name, e in following.items():
        inside[f"__i_{name}"] = F.last(e, ignorenulls=True).over(to_come)
        edge.append(F.min_by(e, F.when(e.isNotNull(), key_of_row)).alias(f"__e_{name}"))
        carry.append(F.last(f"__e_{name}", ignorenulls=True).over(after).alias(f"__c_{name}"))
        final.append((name, F.coalesce(f"__i_{name}", f"__c_{name}")))
    for name, e in running.items():
        inside[f"__i_{name}"] = F.sum(e).over(so_far)
        edge.append(F.sum(e).alias(f"__e_{name}"))
        carry.append(F.sum(f"__e_{name}").over(before).alias(f"__c_{name}"))
        final.append((name, F.coalesce(f"__i_{name}", F.lit(0)) + F.coalesce(f"__c_{name}", F.lit(0))))

    carried = df.groupBy(*base).agg(*edge).select(*base, *carry)
    wide = df.withColumns(inside).join(carried, base, "left")
    skip = {*inside, *[f"__c_{n}" for n, _ in final], *[n for n, _ in final]}
    if not keep_block:
        skip.add(BLOCK)
    return wide.select(*[c for c in wide.columns if c not in skip], *[e.alias(n) for n, e in final])


def decayed_sum(df: DataFrame, keys: list[str], position: str, value: Column, alpha: float, name: str) -> DataFrame:
    """Adds the linear recurrence v(k) = alpha * v(k - 1) + value(k) over whole-number positions within ``keys``; positions without a row count as 0.

    Positions are cut into blocks in which alpha falls to 10^-DECAY. Inside a block the recurrence is a running sum of value / alpha^place times alpha^place,
    whose terms neither overflow nor vanish; what a block hands on is one number, which the next blocks take with alpha^length, alpha^2 length, ... until it is
    below what a double can hold. Nothing is collected, and a key of any length is split."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    length = max(1, int(DECAY / -math.log10(alpha)))
    # alpha^(length * reach) is below the smallest double
    reach = math.ceil(330 / (length * -math.log10(alpha)))
    marked = df.withColumns({BLOCK: F.floor(F.col(position) / length).cast("long"), "__b": value})
    marked = marked.withColumn("__p", (F.col(position) - F.col(BLOCK) * length).cast("double"))
    base = [*keys, BLOCK]
    so_far = Window.partitionBy(*base).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(F.col("__b") * F.pow(F.lit(alpha), -F.col("__p"))).over(so_far) * F.pow(F.lit(alpha), "__p")
    ends = marked.groupBy(*base).agg(F.sum(F.col("__b") * F.pow(F.lit(alpha), length - 1 - F.col("__p"))).alias("__e"))
    handed = ends.select(*keys, BLOCK, "__e", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("__i")).select(
        *keys, (F.col(BLOCK) + F.col("__i")).alias(BLOCK), (F.col("__e") * F.pow(F.lit(alpha), (F.col("__i") - 1) * length)).alias("__s"))
    starts = handed.groupBy(*base).agg(F.sum("__s").alias("__s"))
    whole = marked.withColumn("__in", inside).join(starts, base, "left")
    total = F.col("__in") + F.coalesce("__s", F.lit(0.0)) * F.pow(F.lit(alpha), F.col("__p") + 1)
    return whole.select(*df.columns, total.alias(name))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each task to ``n`` rows per key before the
    shuffle (window group limit), so a hot key costs no more than a cold one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
