"""As-of, nearest and point-in-interval joins without cross products.

``asof``            union + one ordered pass: linear in both sides;
``range_join``      equi join on time buckets, for results that list every (point, interval) pair; with ``first`` one as-of lookup;
``range_totals``    first and last point, sums and maxima of every interval, from blocks of blocks of points: no pairs;
``best_covering``   the one best interval over each point: overlaps are settled on the interval
                    side with a binary tree of time nodes, points then do one as-of lookup;
``nearest_interval``, ``exists_within`` are built from those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .ordered import Blocks, ordered


@dataclass(frozen=True)
class Side:
    """A right side of an as-of lookup: its rows, time, wanted columns and the sense of the search."""

    rows: DataFrame
    time: str
    columns: list
    direction: str = "backward"
    strict: bool = False
    tolerance: float | None = None
    tie: Column | None = None
    prefix: str = "m_"


def asof_many(left: DataFrame, sides: list[Side], keys: list[str], left_time: str, blocks: Blocks) -> DataFrame:
    """Several as-of lookups on the same keys in one ordered pass: all sides and the left rows are put on
    one time line. Right rows sharing key and time are first reduced to the one with the smallest ``tie``."""
    t = F.col(left_time).cast("double")
    line = left.select(*keys, t.alias("__t"), F.lit(1).alias("__o"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    last, following = {}, {}
    for i, s in enumerate(sides):
        at = F.col(s.time).cast("double")
        body = F.struct(at.alias("time"), *[F.col(c).alias(c) for c in s.columns])
        tie = s.tie if s.tie is not None else F.struct(*[F.col(c) for c in s.columns] or [at])
        # a row at the left row's own time must come before it in the sense of the search to be seen
        rank = {"backward": 2 if s.strict else 0, "forward": 0 if s.strict else 2, "nearest": 0}[s.direction]
        one = s.rows.where(at.isNotNull()).groupBy(*keys, at.alias("__t")).agg(F.min_by(body, tie).alias(f"__r{i}"))
        line = line.unionByName(one.withColumn("__o", F.lit(rank)), allowMissingColumns=True)
        if s.direction != "forward":
            last[f"__b{i}"] = F.col(f"__r{i}")
        if s.direction != "backward":
            following[f"__f{i}"] = F.col(f"__r{i}")
    hit = ordered(line, keys, ["__t", "__o"], blocks, last=last, following=following).where(F.col("__l").isNotNull())
    out = []
    for i, s in enumerate(sides):
        back = F.col(f"__b{i}") if f"__b{i}" in last else None
        ahead = F.col(f"__f{i}") if f"__f{i}" in following else None
        gap_b = F.col("__t") - back["time"] if back is not None else None
        gap_f = ahead["time"] - F.col("__t") if ahead is not None else None
        if ahead is None:
            chosen, gap = back, gap_b
        elif back is None:
            chosen, gap = ahead, gap_f
        else:
            take = gap_b.isNull() | (gap_f < gap_b)
            chosen, gap = F.when(take, ahead).otherwise(back), F.when(take, gap_f).otherwise(gap_b)
        if s.tolerance is not None:
            chosen = F.when(gap <= s.tolerance, chosen)
        hit = hit.withColumn(f"__m{i}", chosen)
        out += [F.col(f"__m{i}.time").alias(f"{s.prefix}time")] + [F.col(f"__m{i}.{c}").alias(f"{s.prefix}{c}") for c in s.columns]
    return hit.select("__l.*", *out)


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
         columns: list[str], blocks: Blocks, *, direction: str = "backward", strict: bool = False,
         tolerance: float | None = None, tie: Column | None = None, prefix: str = "m_",
         how: str = "left") -> DataFrame:
    """For each left row the right row of the same key that is latest at or before it (``backward``),
    earliest at or after it (``forward``) or closest (``nearest``, the earlier one on a tie). ``strict``
    leaves out equal times. Adds ``{prefix}time`` and the columns; ``how='inner'`` drops rows without one."""
    side = Side(right, right_time, columns, direction, strict, tolerance, tie, prefix)
    out = asof_many(left, [side], keys, left_time, blocks)
    return out.where(F.col(f"{prefix}time").isNotNull()) if how == "inner" else out


def _known(*names: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull()
    return out


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, low: str, high: str,
               bucket: float, how: str = "inner", *, first: str | None = None, blocks: Blocks | None = None) -> DataFrame:
    """All (point, interval) pairs with low <= time <= high. Intervals are listed in every time
    bucket they touch, so the join is an equi join on (keys, bucket); adaptive execution splits
    a bucket that is still too large. Interval columns must not clash with point columns.

    With ``first`` (the column that orders points of equal time) only the pair of each interval with its first point: one
    ordered pass on ``blocks``, linear however many points an interval holds."""
    if first is not None:
        if how != "inner" or blocks is None:
            raise ValueError("first needs an inner join and blocks")
        rows = points.where(_known(*keys)).select(*keys, F.col(time).alias("__at"), F.struct(*points.columns).alias("__row"))
        held = intervals.where(_known(*keys) & (F.col(low) <= F.col(high)))
        found = asof(held, rows, keys, low, "__at", ["__row"], blocks, direction="forward", tie=F.struct(f"__row.{first}"), prefix="__p_", how="inner")
        return found.where(F.col("__p_time") <= F.col(high)).select("__p___row.*", *[c for c in intervals.columns if c not in keys])
    step = F.lit(float(bucket))
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn(
        "__bucket", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step))))
    marked = points.withColumn("__bucket", F.floor(F.col(time) / step))
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "__bucket"]]
    on += [F.col(f"p.{time}") >= F.col(f"i.{low}"), F.col(f"p.{time}") <= F.col(f"i.{high}")]
    out = marked.alias("p").join(spread.alias("i"), on, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("__bucket")
    return out.select("p.*", *[F.col(f"i.{c}") for c in intervals.columns if c not in keys]).drop("__bucket")


FOLD = 64


def range_totals(points: DataFrame, intervals: DataFrame, keys: list[str], ids: list[str], time: str, low: str, high: str, order: list[str],
                 body: list[str], counts: dict[str, Column], sums: dict[str, Column], tops: dict[str, Column], blocks: Blocks) -> DataFrame:
    """Per (keys, ids) of the intervals that hold points: ``body`` of the first and the last point by (time, ``order``) as structs ``first`` and
    ``last``, and the ``counts`` (whole numbers), ``sums`` (doubles; neither may be NULL) and ``tops`` (maxima) of the points with
    low <= time <= high. Rows of one id count together.

    Points and edges go through one ordered pass, which numbers the points and gives each interval its first and last number. Runs of ``FOLD``
    numbers are gathered in one row, with their totals as a point of the next level. An interval takes from a level the parts of the
    two runs it begins and ends in, and what lies between from the next level, so its work grows with the logarithm of the points it holds.
    Where it lies in one run or two neighbours, its doubles are added point by point in order."""
    spans = intervals.where(_known(*keys) & (F.col(low) <= F.col(high))).groupBy(*keys, *ids, low, high).agg(F.count("*").alias("__times"))
    sides = [F.struct(F.col(c).cast("double").alias("__t"), F.lit(o).alias("__o")) for c, o in ((low, 0), (high, 2))]
    edges = spans.select(*keys, F.struct(*ids, low, high, "__times").alias("__span"), F.explode(F.array(*sides)).alias("__e")).select(*keys, "__span", "__e.*")
    held = points.where(_known(*keys, time)).select(
        *keys, F.col(time).cast("double").alias("__t"), F.lit(1).alias("__o"), F.struct(*order).alias("__by"), F.struct(*body).alias("__body"),
        F.struct(*[c.alias(n) for n, c in {**counts, **sums, **tops}.items()]).alias("__v"))
    line = ordered(held.unionByName(edges, allowMissingColumns=True), keys, ["__t", "__o", "__by"], blocks, running={"__count": (F.col("__o") == 1).cast("long")})
    line = cut(line.select(*keys, "__span", "__o", "__body", "__v", (F.col("__count") - 1).alias("__rank")))
    asked = line.where("__o <> 1").groupBy(*keys, "__span").agg(
        F.max(F.when(F.col("__o") == 0, F.col("__rank") + 1)).alias("__lo"), F.max(F.when(F.col("__o") == 2, F.col("__rank"))).alias("__hi"))
    asked = cut(asked.where("__lo <= __hi"))
    rows = line.where("__o = 1").select(*keys, "__rank", "__body", "__v")
    most = rows.agg(F.max("__rank")).first()[0] or 0
    bits = FOLD.bit_length() - 1
    run, first_run, last_run = (F.call_function("shiftright", F.col(c), F.lit(bits)) for c in ("__rank", "__lo", "__hi"))
    merged = F.struct(*[F.sum(f"__v.{n}").alias(n) for n in (*counts, *sums)], *[F.max(f"__v.{n}").alias(n) for n in tops])

    def added(values):
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


    def added(values):
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    parts = None
    while True:
        runs = rows.groupBy(*keys, run.alias("__run")).agg(F.collect_list(F.struct("__rank", "__body", "__v")).alias("__in"), merged.alias("__v"))
        visits = asked.select("*", F.explode(F.array_distinct(F.array(first_run, last_run))).alias("__run"))
        got = visits.join(runs.drop("__v"), [*keys, "__run"]).withColumn("__in", F.array_sort(F.filter(
            "__in", lambda r: (r["__rank"] >= F.col("__lo")) & (r["__rank"] <= F.col("__hi")))))
        totals = [F.aggregate(F.col(f"__in.__v.{n}"), F.lit(0).cast("long"), lambda a, v: a + v).alias(n) for n in counts]
        totals += [F.array_max(F.col(f"__in.__v.{n}")).alias(n) for n in tops]
        # the second of two neighbours hands on its numbers, to be added to the first one's
        follows = (F.col("__run") > first_run) & (last_run == first_run + 1)
        totals += [F.when(follows, F.col(f"__in.__v.{n}")).otherwise(F.array(added(f"__in.__v.{n}"))).alias(n) for n in sums]
        ends = [F.struct(F.element_at("__in", i)["__rank"].alias("r"), F.element_at("__in", i)["__body"].alias("b")).alias(n) for n, i in (("first", 1), ("last", -1))]
        part = got.select(*keys, "__span", F.col("__run"), *(ends if parts is None else []), *totals)
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        most >>= bits
        if not most:
            break
        rows = cut(runs.select(*keys, F.col("__run").alias("__rank"), F.lit(None).cast("boolean").alias("__body"), "__v"))
        asked = asked.select(*keys, "__span", (first_run + 1).alias("__lo"), (last_run - 1).alias("__hi")).where("__lo <= __hi")
    whole = parts.groupBy(*keys, "__span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(n).alias(n) for n in counts], *[F.max(n).alias(n) for n in tops],
        F.array_sort(F.collect_list(F.struct("__run", *sums))).alias("__s"))
    times = F.col("__span.__times")
    return whole.groupBy(*keys, *[F.col(f"__span.{c}").alias(c) for c in ids]).agg(
        F.min("first")["b"].alias("first"), F.max("last")["b"].alias("last"), *[F.sum(F.col(n) * times).alias(n) for n in counts],
        *[F.sum(added(F.flatten(F.col(f"__s.{n}"))) * times).alias(n) for n in sums], *[F.max(n).alias(n) for n in tops])


def exists_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                  window: float, blocks: Blocks, name: str) -> DataFrame:
    """Adds a flag: some right row of the key lies within +-window of the left row."""
    out = asof(left, right, keys, left_time, right_time, [], blocks, direction="nearest", tolerance=window,
               prefix="__x_")
    return out.withColumn(name, F.col("__x_time").isNotNull()).drop("__x_time")


def _whole_span(low: str, high: str) -> tuple[Column, Column]:
    """The whole numbers inside [low, high] as [first, end): fractional edges are drawn inward."""
    return F.ceil(F.col(low)).cast("long"), F.floor(F.col(high)).cast("long") + 1


def _levels(length: Column) -> Column:
    """Levels of the node tree that an interval of this length can use; as many as it asks for."""
    return F.least(F.floor(F.log2(length)) + 1, F.lit(62)).cast("int")


def _tree_nodes(intervals: DataFrame, keys: list[str], low: str, high: str, rank: Column, body: Column) -> DataFrame:
    """Best interval per time node of a binary tree; an interval splits into at most two nodes per level
    and needs no level above its own length."""
    lo, end = _whole_span(low, high)
    top = _levels(end - lo)
    rows = intervals.where(lo < end).select(*keys, lo.alias("__lo"), end.alias("__end"), rank.alias("__rank"), body.alias("__body"),
                                            F.explode(F.sequence(F.lit(0), top)).alias("__level"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__level"))
    first = F.call_function("shiftright", F.col("__lo") + size - 1, F.col("__level"))
    stop = F.call_function("shiftright", F.col("__end"), F.col("__level"))
    rows = rows.withColumns({"__first": first, "__stop": stop}).where("__first < __stop")
    picks = F.array_compact(F.array(F.when(F.col("__first") % 2 != 0, F.col("__first")),
                                    F.when(F.col("__stop") % 2 != 0, F.col("__stop") - 1)))
    listed = rows.select(*keys, "__level", "__rank", "__body", F.explode(picks).alias("__node"))
    return listed.groupBy(*keys, "__level", "__node").agg(F.max(F.struct("__rank", "__body")).alias("__best"))


def covering_steps(intervals: DataFrame, keys: list[str], low: str, high: str, rank: list[Column],
                   columns: list[str]) -> DataFrame:
    """Step function of the best interval over time: (keys, __b, __body) from each border on.

    Each border looks its answer up on the path from its time node to the root of the node tree."""
    body = F.struct(*[F.col(c) for c in columns])
    nodes = _tree_nodes(intervals, keys, low, high, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]), body)
    lo, end = _whole_span(low, high)
    longest = intervals.groupBy(*keys).agg(F.max(end - lo).alias("__len"))
    borders = (intervals.select(*keys, F.explode(F.array(lo, end)).alias("__b")).distinct().join(longest.where("__len >= 1"), keys))
    top = _levels(F.col("__len"))
    paths = borders.withColumn("__level", F.explode(F.sequence(F.lit(0), top))).drop("__len").withColumn(
        "__node", F.call_function("shiftright", F.col("__b"), F.col("__level")))
    return (paths.join(nodes, [*keys, "__level", "__node"], "left").groupBy(*keys, "__b")
            .agg(F.max("__best").alias("__best")).select(*keys, "__b", F.col("__best.__body").alias("__body")))


def best_covering(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, low: str, high: str,
                  rank: list[Column], columns: list[str], blocks: Blocks, prefix: str = "m_") -> DataFrame:
    """The interval with the largest ``rank`` among those that contain the point's time, both ends included; NULL
    columns when none does. Point times are whole numbers in any unit; interval edges may be fractional.

    Between two neighbouring interval borders the answer is constant, so each point takes over the answer
    of the last border before it. Nothing lists (point, interval) pairs, so any overlap is safe."""
    # an ordered pass reads its input twice: the node tree is worked out once
    steps = cut(covering_steps(intervals, keys, low, high, rank, columns))
    out = asof(points, steps, keys, time, "__b", ["__body"], blocks, prefix="__s_", tie=F.col("__b"))
    return out.select(*points.columns, *[F.col(f"__s___body.{c}").alias(f"{prefix}{c}") for c in columns])


def nearest_interval(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, low: str, high: str,
                     columns: list[str], blocks: Blocks, *, tolerance: float, tie: str, prefix: str = "m_") -> DataFrame:
    """The nearest interval within ``tolerance``: distance 0 inside, else the gap to the nearer edge; the
    longer interval wins a tie, then the smaller ``tie`` value. Adds ``{prefix}gap``. One ordered pass."""
    iv = intervals.withColumn("__len", F.col(high) - F.col(low))
    cols = list(dict.fromkeys([*columns, tie, "__len"]))
    longest = F.struct(-F.col("__len"), F.col(tie))
    steps = cut(covering_steps(iv, keys, low, high, [F.col("__len"), -F.col(tie)], cols))
    both = asof_many(points, [
        Side(steps, "__b", ["__body"], prefix="__in_", tie=F.col("__b")),
        Side(iv, high, cols, strict=True, tie=longest, tolerance=tolerance, prefix="__pa_"),
        Side(iv, low, cols, "forward", True, tolerance, longest, "__fu_")], keys, time, blocks)

    def option(row, gap):
        return F.when(row(tie).isNotNull(), F.struct(
            gap.cast("double").alias("gap"), (-row("__len")).alias("len"), row(tie).alias("tie"),
            *[row(c).alias(c) for c in columns if c != tie]))

    best = F.array_min(F.array_compact(F.array(
        option(lambda c: F.col(f"__in___body.{c}"), F.lit(0.0)),
        option(lambda c: F.col(f"__pa_{c}"), F.col(time) - F.col("__pa_time")),
        option(lambda c: F.col(f"__fu_{c}"), F.col("__fu_time") - F.col(time)))))
    out = both.withColumn("__best", best)
    picked = [F.col("__best.tie" if c == tie else f"__best.{c}").alias(f"{prefix}{c}") for c in columns]
    return out.select(*points.columns, *picked, F.col("__best.gap").alias(f"{prefix}gap"))


def interpolate_lookup(points: DataFrame, series: DataFrame, keys: list[str], at: str, axis: str, value: str,
                       name: str) -> DataFrame:
    """Value of a dense whole-number series at a fractional position: linear between the two
    neighbours, clamped to the ends. Two equi joins on (keys, axis); no sorting."""
    ends = series.groupBy(*keys).agg(F.min(axis).alias("__lo"), F.max(axis).alias("__hi"))
    held = points.join(ends, keys, "left").withColumn(
        "__p", F.when(F.col(at).isNotNull(), F.least(F.greatest(F.col(at), F.col("__lo")), F.col("__hi"))))
    held = held.withColumn("__f", F.floor("__p").cast("long"))
    lower = series.select(*keys, F.col(axis).cast("long").alias("__f"), F.col(value).alias("__v0"))
    upper = series.select(*keys, (F.col(axis).cast("long") - 1).alias("__f"), F.col(value).alias("__v1"))
    out = held.join(lower, [*keys, "__f"], "left").join(upper, [*keys, "__f"], "left")
    frac = F.col("__p") - F.col("__f")
    blend = F.when(frac == 0, F.col("__v0")).otherwise(F.col("__v0") + (F.col("__v1") - F.col("__v0")) * frac)
    return out.select(*points.columns, blend.alias(name))
