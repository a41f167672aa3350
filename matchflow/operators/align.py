"""Alignment of tracking with events, and the smooth correction of badly aligned trajectories."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clip, distance
from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH
from ..lineage import cut
from .intervals import asof
from .ordered import Blocks, ordered
from .tracking import TRACKING_BLOCKS


@dataclass(frozen=True)
class AlignRules:
    tolerance_ms: int = 400
    error_m: float = 1.5
    ball_m: float = 2.0
    reference_ms: int = 500
    skip_m: float = 0.25
    rows_before: int = 4
    rows_after: int = 4
    throw_back_ms: int = 4000
    throw_min_ms: int = 2500
    throw_after_ms: int = 3000
    null_run: int = 3
    length: float = PITCH_LENGTH
    width: float = PITCH_WIDTH

    def __post_init__(self):
        if not 0 <= self.rows_before <= len(SETPIECE_WEIGHTS) or not 0 <= self.rows_after <= len(POST_WEIGHTS):
            raise ValueError(f"weights are fixed for up to {len(SETPIECE_WEIGHTS)} rows before and {len(POST_WEIGHTS)} rows after an event")


# Shift weights after the event, before a set piece, and blends of the ball.
POST_WEIGHTS = (0.95, 0.85, 0.70, 0.50, 0.30, 0.15)
SETPIECE_WEIGHTS = (0.30, 0.50, 0.70, 0.85, 0.97)
SETPIECE_KINDS = ("throwin", "goalkick", "freekick")
BALL_BLEND = {"anchor": 0.90, "before": 0.35, "after": 0.20, "setpiece": 0.98}

KEYS = ["match_id", "period"]
BLOCK_RANKS = 1 << 14
REPLAY_ROWS = 1 << 16


def match_events(events: DataFrame, tracking: DataFrame, rules: AlignRules = AlignRules(),
                 blocks: Blocks = TRACKING_BLOCKS) -> DataFrame:
    """Each event with its player's nearest tracking row in time, when within the tolerance."""
    cols = ["frame", "x", "y", "ball_x", "ball_y"]
    return asof(events, tracking.select(*KEYS, "player_id", "match_time", *cols), [*KEYS, "player_id"], "match_time",
                "match_time", cols, blocks, direction="nearest", tolerance=rules.tolerance_ms, tie=F.col("frame"),
                prefix="track_", how="inner")


def candidates(matched: DataFrame, rules: AlignRules = AlignRules()) -> DataFrame:
    """Events whose position is far from the tracked player who is far from the ball."""
    def metres(c, size):
        return F.col(c) * F.lit(size)

    L, W = rules.length, rules.width
    err = distance(metres("x", L), metres("y", W), metres("track_x", L), metres("track_y", W))
    ball = distance(metres("track_x", L), metres("track_y", W), metres("track_ball_x", L), metres("track_ball_y", W))
    return matched.withColumns({"error_m": err, "player_ball_m": ball}).where(
        (F.col("error_m") > rules.error_m) & (F.col("player_ball_m") > rules.ball_m))


def reference_event(cands: DataFrame, events: DataFrame, columns: list[str], window_ms: float,
                    blocks: Blocks = TRACKING_BLOCKS, team: str | None = "team_id", ordinal: str = "match_time",
                    prefix: str = "ref_") -> DataFrame:
    """Closest event within the window: of the same player if any, else of the same team, else any.

    Three nearest-time lookups instead of a pair list; the level used is in ``{prefix}level``."""
    levels = [("player_id", 1)] + ([(team, 2)] if team and team in cands.columns else []) + [(None, 3)]
    out, cols = cands, list(dict.fromkeys(columns))
    for key, level in levels:
        keys = [*KEYS, key] if key else KEYS
        names = [c for c in cols if c not in keys]
        body = events.select(*keys, "match_time", *[c for c in names if c != "match_time"], *(
            [ordinal] if ordinal not in [*keys, "match_time", *names] else []))
        out = asof(out, body, keys, "match_time", "match_time", names, blocks, direction="nearest",
                   tolerance=window_ms, tie=F.col(ordinal), prefix=f"__{level}_")
        if key in cols:
            out = out.withColumn(f"__{level}_{key}", F.when(F.col(f"__{level}_time").isNotNull(), F.col(key)))
    found = F.lit(None).cast("int")
    for _, level in reversed(levels):
        found = F.when(F.col(f"__{level}_time").isNotNull(), F.lit(level)).otherwise(found)
    out = out.withColumn(f"{prefix}level", found)

    def pick(c):
        return F.coalesce(*[F.when(F.col(f"{prefix}level") == lv, F.col(f"__{lv}_{c}")) for _, lv in levels])

    out = out.withColumns({f"{prefix}{c}": pick(c) for c in ["time", *cols]})
    return out.drop(*[f"__{lv}_{c}" for _, lv in levels for c in ["time", *cols]])


def pre_weights(n: int, setpiece: bool) -> list[float]:
    if setpiece:
        return list(SETPIECE_WEIGHTS[-n:]) if n > 0 else []
    return [(i / n) ** 0.6 for i in range(1, n + 1)]


def shift_weight(k, n_before, setpiece, rules: AlignRules = AlignRules()):
    """Weight column for the row ``k`` places after (negative: before) the anchor."""
    n, i = n_before, k + n_before  # i = 0 .. n-1 for rows before
    normal = F.pow((i + 1) / F.when(n > 0, n), F.lit(0.6))
    tail = F.try_element_at(F.array(*[F.lit(w) for w in SETPIECE_WEIGHTS]),
                            (F.lit(len(SETPIECE_WEIGHTS)) - n + i + 1).cast("int"))
    post = F.try_element_at(F.array(*[F.lit(w) for w in POST_WEIGHTS]), F.greatest(k, F.lit(1)).cast("int"))
    return F.when(k == 0, F.lit(1.0)).when(k > 0, post).when(setpiece, tail).otherwise(normal)


def recalibrate_single(tracking: DataFrame, events: DataFrame, rules: AlignRules = AlignRules(),
                       blocks: Blocks = TRACKING_BLOCKS) -> DataFrame:
    """Correction of events whose windows do not touch: pure joins, no ordering between events.

    ``events``: match_id, period, player_id, match_time, x, y, setpiece_type. Returns tracking with shifted
    x, y and ball; coordinates clipped to the pitch."""
    keys = [*KEYS, "player_id"]
    ranked = cut(ordered(tracking, keys, ["match_time", "frame"], blocks, running={"__rank": F.lit(1)}))
    anchor = asof(events.select(*keys, "match_time", "x", "y", "setpiece_type"),
                  ranked.select(*keys, "match_time", "frame", "x", "y", "__rank"), keys, "match_time", "match_time",
                  ["x", "y", "__rank"], blocks, direction="nearest", tie=F.col("frame"), prefix="a_", how="inner")
    anchor = anchor.withColumns({"dx": F.col("x") - F.col("a_x"), "dy": F.col("y") - F.col("a_y")})
    off = F.sqrt(F.pow(F.col("dx") * rules.length, 2) + F.pow(F.col("dy") * rules.width, 2))
    setpiece = F.coalesce(F.lower("setpiece_type").isin(*SETPIECE_KINDS), F.lit(False))
    moves = anchor.where(off > rules.skip_m).select(
        *keys, F.col("match_time").alias("event_time"), "dx", "dy", setpiece.alias("setpiece"),
        F.col("a___rank").alias("anchor_rank"),
        F.least(F.col("a___rank") - 1, F.lit(rules.rows_before)).alias("n_before"),
        F.explode(F.sequence(F.lit(-rules.rows_before), F.lit(rules.rows_after))).alias("k"))
    moves = moves.where(F.col("anchor_rank") + F.col("k") >= 1).withColumn("__rank", F.col("anchor_rank") + F.col("k"))
    moves = moves.withColumn("w", shift_weight(F.col("k"), F.col("n_before"), F.col("setpiece"), rules))
    step = moves.groupBy(*keys, "__rank").agg(
        F.sum(F.col("w") * F.col("dx")).alias("sx"), F.sum(F.col("w") * F.col("dy")).alias("sy"),
        F.max("w").alias("w"), F.max("setpiece").alias("setpiece"), F.max("event_time").alias("event_time"))
    moved = ranked.join(step, [*keys, "__rank"], "left").withColumns({
        "x": F.col("x") + F.coalesce("sx", F.lit(0.0)), "y": F.col("y") + F.coalesce("sy", F.lit(0.0))})
    blend = (F.when(F.col("setpiece"), F.when(F.col("w") == 1, F.lit(BALL_BLEND["setpiece"])))
             .when(F.col("w") == 1, F.lit(BALL_BLEND["anchor"]))
             .when(F.col("match_time") < F.col("event_time"), F.lit(BALL_BLEND["before"]))
             .when(F.col("w").isNotNull(), F.lit(BALL_BLEND["after"])))
    pull = moved.withColumn("b", blend).where(F.col("b").isNotNull()).groupBy(*KEYS, "frame").agg(
        F.max("b").alias("b"), F.max_by("x", "b").alias("px"), F.max_by("y", "b").alias("py"))
    out = moved.join(pull, [*KEYS, "frame"], "left")
    known = F.col("b").isNotNull() & F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()
    out = out.withColumns({
        "ball_x": F.when(known, (1 - F.col("b")) * F.col("ball_x") + F.col("b") * F.col("px")).otherwise(F.col("ball_x")),
        "ball_y": F.when(known, (1 - F.col("b")) * F.col("ball_y") + F.col("b") * F.col("py")).otherwise(F.col("ball_y"))})
    out = out.select(*tracking.columns)
    return out.withColumns({c: clip(c, 0, 1) for c in ("x", "y", "ball_x", "ball_y")})


def ball_outs(frames: DataFrame, throwins: DataFrame, rules: AlignRules = AlignRules(),
              blocks: Blocks = TRACKING_BLOCKS) -> DataFrame:
    """When the ball went out before each throw-in: the frame before the last run of at least ``null_run``
    ball-less frames up to the throw-in, or the fall-back when there is none or it is too recent.

    A throw-in puts the ball back into the frames between its out time and itself, so later throw-ins no longer see that run. The
    ordered passes are split into blocks; they turn ball-less frames into one row per run, and times into frame numbers. What is walked in event
    order is runs and throw-ins, never frames: a throw-in finds its run, takes it out and cuts its neighbours by binary
    search. ``frames`` is one row per (match, period, frame), ``throwins`` has match_time, first_ms (the player's first row) and event_no.
    Returns out_ms per event."""
    lost = F.col("ball_x").isNull() | F.col("ball_y").isNull()
    line = cut(ordered(frames.select(*KEYS, "frame", F.col("match_time").cast("double").alias("match_time"), lost.alias("lost")), KEYS, ["match_time", "frame"],
                       blocks, lag={"prev_ms": F.col("match_time")}, running={"idx": F.lit(1), "gone": F.col("lost").cast("long")}))
    # a run's frames are neighbours, so place less number of lost frames is the same in all of them
    runs = line.where("lost").groupBy(*KEYS, (F.col("idx") - F.col("gone")).alias("__run")).agg(
        F.min("idx").cast("long").alias("i0"), F.max("idx").cast("long").alias("i1"), F.min_by("prev_ms", "idx").alias("prev"))
    runs = runs.where((F.col("i1") - F.col("i0") + 1 >= rules.null_run) & F.col("prev").isNotNull()).drop("__run")
    t = F.col("match_time").cast("double")
    asked = throwins.select(*KEYS, "event_no", t.alias("when"), F.greatest(F.col("first_ms").cast("double"), t - rules.throw_back_ms).alias("back"))
    asked = asof(asked, line, KEYS, "when", "match_time", ["idx"], blocks, tie=-F.col("idx"), prefix="w_")
    asked = asof(asked, line, KEYS, "back", "match_time", ["idx"], blocks, direction="forward", tie=F.col("idx"), prefix="b_")
    asked = asked.select(*KEYS, F.col("event_no").cast("long").alias("event_no"), "when", "back", F.col("w_idx").cast("long").alias("at"),
                         F.col("w_time").alias("at_ms"), F.col("b_idx").cast("long").alias("back_at"))
    both = runs.unionByName(asked, allowMissingColumns=True)
    schema = T.StructType([f for f in both.schema if f.name in (*KEYS, "event_no")] + [T.StructField("out_ms", T.DoubleType())])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        return settle_outs(pdf, rules)[[f.name for f in schema]]

    return both.groupBy(*KEYS).applyInPandas(settle, schema)


def settle_outs(rows: pd.DataFrame, rules: AlignRules) -> pd.DataFrame:
    """The out time of each throw-in of one period, in event order. Rows are runs (frames i0 to i1 without a ball, ``prev`` the time of the
    frame before) and throw-ins (``at``, ``back_at``: the last frame up to it, the first frame from its fall-back time on)."""
    asked = rows[rows["event_no"].notna()].sort_values("event_no")
    runs = rows[rows["event_no"].isna()].sort_values("i0")
    first, last, prev = runs["i0"].astype("int64").tolist(), runs["i1"].astype("int64").tolist(), runs["prev"].tolist()

    def take_out(low: int, high: int, high_ms: float) -> None:
        """Frames low to high have a ball again; what is left of a run on either side stays when it is long enough."""
        i = bisect_left(last, low)
        j = bisect_right(first, high)
        kept = []
        if i < j:
            kept = [(first[i], low - 1, prev[i]), (high + 1, last[j - 1], high_ms)]
            kept = [r for r in kept if r[1] - r[0] + 1 >= rules.null_run]
        first[i:j], last[i:j], prev[i:j] = [r[0] for r in kept], [r[1] for r in kept], [r[2] for r in kept]

    outs = []
    for when, back, at, at_ms, back_at in asked[["when", "back", "at", "at_ms", "back_at"]].itertuples(index=False):
        if np.isnan(at):  # no frame so far
            outs.append(back)
            continue
        at = int(at)
        i = bisect_right(first, at) - 1
        # at most the run that the throw-in itself falls into is too short for being cut here
        while i >= 0 and min(last[i], at) - first[i] + 1 < rules.null_run:
            i -= 1
        out = prev[i] if i >= 0 else back
        if i < 0 or when - out < rules.throw_min_ms:
            out = back
            if not np.isnan(back_at) and back_at <= at:
                take_out(int(back_at), at, at_ms)
        else:
            take_out(first[i], at, at_ms)
        outs.append(out)
    return asked.assign(out_ms=outs, event_no=asked["event_no"].astype("int64"))


LOG = ("mode string, anchor_ms double, dx double, dy double, error_m double, start_ms double, hold_ms double, stop_ms double")
LOG_NAMES = [c.split()[0] for c in LOG.split(", ")]
MOVED = "x double, y double, dx double, dy double, error_m double, moved boolean"


def _replay(ops: pd.DataFrame, rules: AlignRules) -> pd.DataFrame:
    """Applies the events that touch the rows of each player's block, in order. A row of ``ops`` is a (track row, event) pair; events of other blocks come
    with the shift found there (NaN: left alone, as far as known). Adds the place after each event, and for the block's own events their shift.
    Blocks do not wait for each other: the first events of all of them are applied at once, then the second ones, and so on."""
    unit = ops.groupby([*KEYS, "player_id", "block"], sort=False, dropna=False).ngroup().to_numpy()
    number, rank = ops["event_no"].to_numpy(), ops["rank"].to_numpy()
    order = np.lexsort((rank, number, unit))
    other = np.diff(unit[order], prepend=-1) != 0
    fresh = other | (np.diff(number[order], prepend=number[order][:1]) != 0)
    event = np.cumsum(fresh) - 1
    turn = event - np.maximum.accumulate(np.where(other, event, 0))
    later = np.argsort(turn, kind="stable")
    order, turn, event = order[later], turn[later], event[later]
    ops, unit, rank = ops.iloc[order].reset_index(drop=True), unit[order], rank[order]
    n = len(ops)
    # the row that speaks for each event, its first one
    first = np.maximum.accumulate(np.where(np.diff(event, prepend=-1) != 0, np.arange(n), 0))
    sorted_ = np.lexsort((rank, unit))
    at = np.empty(n, np.int64)
    at[sorted_] = np.cumsum((np.diff(unit[sorted_], prepend=-1) != 0) | (np.diff(rank[sorted_], prepend=0) != 0)) - 1
    here = np.full((n, 2), np.nan)
    here[at] = ops[["x0", "y0"]].to_numpy(float)
    own, throw, shown = (ops[c].to_numpy(bool)[first] for c in ("own", "throw", "shown"))
    goal, given = ops[["tx", "ty"]].to_numpy(float)[first], ops[["gx", "gy"]].to_numpy(float)[first]
    # the place of the anchor row, which each event of the block's own touches
    anchors = np.flatnonzero(rank == ops["a_rank"].to_numpy()[first])
    anchor = np.zeros(n, np.int64)
    anchor[first[anchors]] = at[anchors]
    anchor = anchor[first]
    weight = ops["w"].to_numpy(float)[:, None]
    span = np.array([rules.length, rules.width])
    after, shift, error, moved = np.full((n, 2), np.nan), np.full((n, 2), np.nan), np.full(n, np.nan), np.zeros(n, bool)
    edges = np.r_[np.flatnonzero(np.diff(turn, prepend=-1) != 0), n] if n else [0]
    for lo, hi in zip(edges[:-1], edges[1:]):
        rows, w, mine, thrown = at[lo:hi], weight[lo:hi], own[lo:hi], throw[lo:hi]
        found = goal[lo:hi] - here[anchor[lo:hi]]
        far = np.hypot(*(found * span).T)
        shift[lo:hi], error[lo:hi] = np.where(mine[:, None], found, np.nan), np.where(mine, far, np.nan)
        goes = thrown | np.where(mine, ~(far <= rules.skip_m), shown[lo:hi])
        d = np.where(mine[:, None], found, given[lo:hi])
        to = np.where(thrown[:, None], (1 - w) * here[rows] + w * goal[lo:hi], here[rows] + w * d)
        here[rows] = np.where(goes[:, None], to, here[rows])
        moved[lo:hi] = goes
        after[lo:hi] = here[rows]
    return ops.assign(x=after[:, 0], y=after[:, 1], dx=shift[:, 0], dy=shift[:, 1], error_m=error, moved=moved)


def _settled(ops: DataFrame, rules: AlignRules) -> DataFrame:
    """``ops`` with the place after each event. Each (player, block) is worked out alone, about ``REPLAY_ROWS`` rows of whole blocks in one
    call; a block starts without the shifts of events anchored in its neighbours. Shifts that reach over a border are passed on and the blocks that get another one than before are done again, until
    none changes. An event is right once those before it are, so this ends; it takes one round more than there are borders in the longest chain
    of touching events, and where no window reaches over a border a single one."""
    player = [*KEYS, "player_id"]
    schema = T.StructType([*[f for f in ops.schema], T.StructField("gx", T.DoubleType()), T.StructField("gy", T.DoubleType()), T.StructField("shown", T.BooleanType()),
                           *T.StructType.fromDDL(MOVED)])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        return _replay(pdf, rules)[[f.name for f in schema]]

    parts = -(-ops.count() // REPLAY_ROWS) or 1
    part = F.pmod(F.xxhash64(*player, "block"), F.lit(parts)).alias("__part")
    none = {"gx": F.lit(None).cast("double"), "gy": F.lit(None).cast("double"), "shown": F.lit(False)}
    done = cut(ops.withColumns(none).groupBy(part).applyInPandas(replay, schema))
    over = cut(ops.where("NOT own AND NOT throw").select(*player, "block", "event_no").distinct())
    if over.isEmpty():
        return done
    reaching = over.select(*player, "event_no").distinct()
    nan = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(n) for c, n in (("dx", "gx"), ("dy", "gy"))]
    known = None
    while True:
        now = cut(done.where("own AND rank = a_rank").join(reaching, [*player, "event_no"], "left_semi").select(
            *player, "event_no", *nan, F.col("moved").alias("shown")))
        fresh = now if known is None else now.exceptAll(known)
        # before the first round, events were taken as left alone
        fresh = fresh.where("shown") if known is None else fresh
        stale = cut(over.join(fresh.select(*player, "event_no"), [*player, "event_no"], "left_semi").select(*player, "block").distinct())
        if stale.isEmpty():
            return done
        known = now
        again = ops.join(stale, [*player, "block"], "left_semi").join(now, [*player, "event_no"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
        again = again.groupBy(part).applyInPandas(replay, schema)
        done = cut(done.join(stale, [*player, "block"], "left_anti").unionByName(again))


def _balls(done: DataFrame, starts: DataFrame, rules: AlignRules) -> DataFrame:
    """The ball of each edited frame: the edits of the frame in event order. ``starts``: the ball of each frame before."""
    kick, when = F.col("setpiece"), F.col("t") <= F.col("match_time")
    share = (F.when(F.col("throw"), F.when(when & (F.col("w") >= 0), F.lit(1.0)))
             .when(kick, F.when(F.col("w") == 1, F.lit(BALL_BLEND["setpiece"])))
             .when(F.col("w") == 1, F.lit(BALL_BLEND["anchor"]))
             .when(F.col("t") < F.col("match_time"), F.lit(BALL_BLEND["before"])).otherwise(F.lit(BALL_BLEND["after"])))
    edits = done.where("moved AND touched").withColumn("share", share).where("share IS NOT NULL").select(
        *KEYS, "frame", F.struct("event_no", "rank", "throw", "share", F.when(F.col("throw"), F.col("tx")).otherwise(F.col("x")).alias("x"),
                                 F.when(F.col("throw"), F.col("ty")).otherwise(F.col("y")).alias("y")).alias("e"))
    # the edits of one frame are those of its players' events within a second or two
    listed = edits.groupBy(*KEYS, "frame").agg(F.sort_array(F.collect_list("e")).alias("e")).join(starts, [*KEYS, "frame"])

    def step(ball, e):
        def blend(now, to):
            return (1 - e["share"]) * now + e["share"] * to
        known = ball["x"].isNotNull() & ball["y"].isNotNull()
        mixed = F.struct(blend(ball["x"], e["x"]).alias("x"), blend(ball["y"], e["y"]).alias("y"))
        return F.when(e["throw"], F.struct(e["x"].alias("x"), e["y"].alias("y"))).when(known, mixed).otherwise(ball)

    start = F.struct(F.col("ball_x").cast("double").alias("x"), F.col("ball_y").cast("double").alias("y"))
    ball = F.aggregate("e", F.struct(start["x"].alias("x"), start["y"].alias("y")), step)
    held = listed.withColumn("b", ball).where("exists(e, e -> e.throw) OR (ball_x IS NOT NULL AND ball_y IS NOT NULL)")
    return held.select(*KEYS, "frame", F.col("b.x").alias("new_bx"), F.col("b.y").alias("new_by"))


def apply_recalibration(tracking: DataFrame, events: DataFrame, rules: AlignRules = AlignRules(),
                        blocks: Blocks = TRACKING_BLOCKS, block_rows: int = BLOCK_RANKS) -> DataFrame:
    """The corrected tracking of ``apply_with_log``."""
    return apply_with_log(tracking, events, rules, blocks, block_rows)[0]


def apply_with_log(tracking: DataFrame, events: DataFrame, rules: AlignRules = AlignRules(),
                   blocks: Blocks = TRACKING_BLOCKS, block_rows: int = BLOCK_RANKS) -> tuple[DataFrame, DataFrame]:
    """All events applied in their order, in three parts that do not wait for each other's rows: the out times of throw-ins (they depend on
    throw-ins and the missing ball alone), the places of each player (they depend on the player's own events alone, ``block_rows`` rows of a player a
    task), and the ball of each frame (a fold of its edits). Untouched rows pass through.

    ``events``: match_id, period, player_id, match_time, x, y, setpiece_type, event_no (order; unique in a period). Returns the
    tracking and the log: per event its anchor, shift, error in metres, mode (general, setpiece, throwin, or near when left
    alone) and the times it reaches from, holds to and reaches to."""
    keys = [*KEYS, "player_id"]
    ev = events.select(*keys, F.col("match_time").cast("double").alias("match_time"), F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty"),
                       F.lower("setpiece_type").alias("setpiece_type"), F.col("event_no").cast("long").alias("event_no"))
    frames = tracking.groupBy(*KEYS, "frame").agg(F.min("match_time").alias("match_time"), F.min_by(
        F.struct("ball_x", "ball_y"), F.struct("match_time", "player_id")).alias("b")).select(*KEYS, "frame", "match_time", "b.ball_x", "b.ball_y")
    frames = cut(frames)
    line = cut(ordered(tracking, keys, ["match_time", "frame"], blocks, running={"__rank": F.lit(1)}))
    ranked = line.select(*keys, "frame", F.col("match_time").cast("double").alias("t"), F.col("x").cast("double").alias("x0"),
                         F.col("y").cast("double").alias("y0"), F.col("__rank").cast("long").alias("rank"))
    ends = ranked.groupBy(*keys).agg(F.max("rank").alias("last_rank"), F.min("t").alias("first_ms"))
    near = asof(ev, ranked, keys, "match_time", "t", ["rank"], blocks, direction="nearest", tie=F.col("rank"), prefix="a_", how="inner")
    near = cut(near.join(ends, keys).drop("a_time"))
    general = near.where("coalesce(setpiece_type, '') <> 'throwin'").withColumns({
        "lo_rank": F.greatest(F.col("a_rank") - rules.rows_before, F.lit(1)), "hi_rank": F.least(F.col("a_rank") + rules.rows_after, F.col("last_rank")),
        "out_ms": F.lit(None).cast("double")})
    throws = near.where("setpiece_type = 'throwin'")
    throws = throws.join(ball_outs(frames, throws, rules, blocks), [*KEYS, "event_no"]).withColumn("stop_ms", F.col("match_time") + rules.throw_after_ms)
    throws = asof(throws, ranked, keys, "out_ms", "t", ["rank"], blocks, direction="forward", tie=F.col("rank"), prefix="lo_")
    throws = asof(throws, ranked, keys, "stop_ms", "t", ["rank"], blocks, tie=-F.col("rank"), prefix="hi_").drop("lo_time", "hi_time", "stop_ms")
    moves = cut(general.unionByName(throws))
    reached = F.when(F.col("lo_rank") <= F.col("hi_rank"), F.sequence("lo_rank", "hi_rank")).otherwise(F.array().cast("array<bigint>"))
    # the anchor of a throw-in is logged even where the throw-in reaches no row
    touched = moves.withColumn("rank", F.explode(F.array_union(reached, F.array("a_rank"))))
    ops = touched.join(ranked, [*keys, "rank"])
    own_block, block = (F.floor((F.col(c) - 1) / block_rows) for c in ("a_rank", "rank"))
    inside = F.coalesce(F.col("rank").between(F.col("lo_rank"), F.col("hi_rank")), F.lit(False))
    kind = F.coalesce(F.col("setpiece_type").isin(*SETPIECE_KINDS), F.lit(False))
    throw = F.coalesce(F.col("setpiece_type") == "throwin", F.lit(False))
    hold = F.col("out_ms") + 0.45 * (F.col("match_time") - F.col("out_ms"))
    t, stop = F.col("t"), F.col("match_time") + rules.throw_after_ms
    late = 1 - clip((t - F.col("match_time")) / F.greatest(F.lit(1.0), stop - F.col("match_time")), 0, 1)
    held = (F.when(t <= hold, F.pow(clip((t - F.col("out_ms")) / F.greatest(F.lit(1.0), hold - F.col("out_ms")), 0, 1), F.lit(0.65)))
            .when(t <= F.col("match_time"), F.lit(0.985)).otherwise(0.985 * F.pow(late, F.lit(0.55))))
    moving = shift_weight(F.col("rank") - F.col("a_rank"), F.least(F.col("a_rank") - 1, F.lit(rules.rows_before)), kind, rules)
    ops = ops.withColumns({"block": block, "own": own_block == block, "throw": throw, "setpiece": kind, "touched": inside}).withColumn(
        "w", F.when(~F.col("throw"), moving).when(inside, held).otherwise(0.0))
    ops = cut(ops.select(*keys, "block", "event_no", "rank", "a_rank", "own", "throw", "setpiece", "touched", "w", "tx", "ty", "x0", "y0", "frame", "t", "match_time"))
    done = _settled(ops, rules)
    clean = done.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("x", "y", "dx", "dy", "error_m")})
    moved = cut(clean.where("moved AND touched").groupBy(*keys, F.col("rank").alias("__rank")).agg(
        F.max_by("x", "event_no").alias("new_x"), F.max_by("y", "event_no").alias("new_y"), F.lit(True).alias("__moved")))
    balls = cut(_balls(clean, frames.drop("match_time"), rules).withColumn("__ball", F.lit(True)))
    out = line.join(moved, [*keys, "__rank"], "left").join(balls, [*KEYS, "frame"], "left")
    put = {"x": ("new_x", "__moved"), "y": ("new_y", "__moved"), "ball_x": ("new_bx", "__ball"), "ball_y": ("new_by", "__ball")}
    out = out.select(*[clip(F.when(F.col(put[c][1]), F.col(put[c][0])).otherwise(F.col(c)), 0, 1).alias(c) if c in put else F.col(c) for c in tracking.columns])
    mode = (F.when(F.col("setpiece_type") == "throwin", "throwin").when(F.col("error_m") <= rules.skip_m, "near")
            .when(kind, "setpiece").otherwise("general"))
    times = ranked.select(*keys, "rank", "t")
    log = moves.join(clean.where("own AND rank = a_rank").select(*keys, "event_no", F.col("t").alias("anchor_ms"), "dx", "dy", "error_m"), [*keys, "event_no"])
    for side in ("lo", "hi"):
        log = log.join(times.withColumnsRenamed({"rank": f"{side}_rank", "t": f"{side}_ms"}), [*keys, f"{side}_rank"], "left")
    log = log.withColumns({"mode": mode, "throw": throw}).withColumns({
        "start_ms": F.when(F.col("throw"), F.col("out_ms")).otherwise(F.col("lo_ms")), "hold_ms": F.when(F.col("throw"), hold),
        "stop_ms": F.when(F.col("throw"), stop).otherwise(F.col("hi_ms"))})
    return out, log.select(*KEYS, "event_no", "player_id", "match_time", F.col("tx").alias("x"), F.col("ty").alias("y"), "setpiece_type", *LOG_NAMES)


def recalibrate(tracking: DataFrame, events: DataFrame, rules: AlignRules = AlignRules(),
                blocks: Blocks = TRACKING_BLOCKS, event_order=None) -> DataFrame:
    """Match, pick candidates, find their reference event, apply in ``event_order`` (a whole-number
    column of the events, time order by default; ties by player and place), then metres and ball distance again; speeds stay."""
    event_order = F.col("match_time").cast("long") if event_order is None else event_order
    found = cut(candidates(match_events(events, tracking, rules, blocks), rules))
    near = reference_event(found.withColumnRenamed("x", "own_x").withColumnRenamed("y", "own_y").drop("team_id"),
                           events.select(*KEYS, "player_id", "match_time", "x", "y", "setpiece_type"),
                           ["x", "y", "setpiece_type"], rules.reference_ms, blocks)
    order = near.where(F.col("ref_level").isNotNull()).select(
        *KEYS, "player_id", F.col("ref_time").alias("match_time"), F.col("ref_x").alias("x"), F.col("ref_y").alias("y"),
        F.col("ref_setpiece_type").alias("setpiece_type"), event_order.alias("__order"))
    # equal order values get numbers of their own, so that each event is applied once
    order = ordered(order, KEYS, ["__order", "player_id", "match_time", "x", "y"], blocks, running={"event_no": F.lit(1)}).drop("__order")
    fixed = apply_recalibration(tracking, cut(order), rules, blocks)
    fixed = fixed.withColumns({
        "x_m": F.col("x") * rules.length, "y_m": F.col("y") * rules.width,
        "ball_x_m": F.col("ball_x") * rules.length, "ball_y_m": F.col("ball_y") * rules.width})
    return fixed.withColumn("ball_dist_m", distance("x_m", "y_m", "ball_x_m", "ball_y_m"))
