"""Attacking-sequence segmentation.

Path I starts from the provider's possession intervals, path II from possession blocks found in the
tracking; a match uses path II only when path I keeps no sequence of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import distance, flag
from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH
from ..functions.jsontext import has_event
from ..lineage import cut
from .events import attack_direction, mirror_by_direction
from .intervals import Side, asof, asof_many, best_covering, range_join, range_totals
from .ordered import Blocks, ordered
from .tracking import TRACKING_BLOCKS

# Event types that end an attack, and types that start one by a regain.
TERMINAL_TYPES = ("recovery", "interception", "ballrecovery", "pass", "clearance", "shot")
REGAIN_TYPES = ("recovery", "interception", "ballrecovery")

SEQ = ["match_id", "period", "cand_id"]


@dataclass(frozen=True)
class SegmentRules:
    max_gap_ms: int = 4000
    transit_ms: int = 3500
    transit_speed: float = 0.3
    min_events: int = 1
    min_path_m: float = 10.0
    min_seconds: float = 1.0
    built_seconds: float = 6.0
    built_events: int = 3
    min_speed: float = 5.5
    short_kick_m: float = 15.0
    setpiece_events: int = 2
    setpiece_seconds: float = 4.0
    kick_m: float = 0.5
    max_seconds: float = 45.0
    direct_gain_m: float = 8.0
    direct_path_m: float = 15.0
    direct_x: float = 0.62
    transition_seconds: float = 10.0
    transition_path_m: float = 10.0
    regain_ms: int = 3000
    terminal_ms: int = 3500
    terminal_buffer_ms: int = 500
    chain_gap_ms: int = 5000
    chain_reach_ms: int = 15000
    light_x: float = 0.57
    light_gain_m: float = 14.0
    bucket_ms: int = 10_000
    length: float = PITCH_LENGTH
    width: float = PITCH_WIDTH


# ------------------------------------------------------------------------------------- possession

def extend_possession(frames: DataFrame, blocks: Blocks = TRACKING_BLOCKS, keys=("match_id", "period"),
                      rules: SegmentRules = SegmentRules()) -> DataFrame:
    """The possessing team, carried on while the ball is in transit. Input: one row per frame."""
    clear = F.when(F.col("possessing_team").isNotNull(), F.struct("possessing_team", "match_time"))
    out = ordered(frames, list(keys), ["match_time", "frame"], blocks, last={"__c": clear}, keep_block=True)
    transit = ((F.col("match_time") - F.col("__c.match_time") <= rules.transit_ms)
               & (F.col("ball_speed") >= rules.transit_speed))
    now = F.col("possessing_team").isNotNull()
    return out.withColumns({
        "team_extended": F.when(now, F.col("possessing_team")).when(transit, F.col("__c.possessing_team")),
        "possession_reason": F.when(now, "poseedor_claro").when(transit, "balon_en_transito").otherwise("sin_control"),
    }).drop("__c")


def possession_blocks(frames: DataFrame, is_rival: Column, blocks: Blocks = TRACKING_BLOCKS,
                      keys=("match_id", "period"), rules: SegmentRules = SegmentRules()) -> DataFrame:
    """Numbers runs of equal rival flag without a long time gap."""
    keys = list(keys)
    marked = frames.withColumn("is_rival", F.coalesce(is_rival, F.lit(False)))
    near = ordered(marked, keys, ["match_time", "frame"], blocks, lag={"__p": F.struct("is_rival", "match_time")},
                   keep_block=True)
    fresh = (~F.col("is_rival").eqNullSafe(F.col("__p.is_rival"))
             | F.coalesce(F.col("match_time") - F.col("__p.match_time") > rules.max_gap_ms, F.lit(False)))
    near = near.withColumn("__new", fresh.cast("long")).drop("__p")
    return ordered(near, keys, ["match_time", "frame"], blocks, running={"block_no": F.col("__new")}).drop("__new")


def _edges(order: Column, columns) -> list[Column]:
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"{c}_start") for c in columns]
    return first + [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"{c}_end") for c in columns]


def block_metrics(frames: DataFrame, keys=("match_id", "period", "block_no")) -> DataFrame:
    """Time, geometry and transit share per block; first and last ball are those of the edge frames."""
    order = F.struct("match_time", "frame")
    columns = [c for c in ("ball_x_m", "ball_y_m", "ball_x_norm", "ball_y_norm") if c in frames.columns]
    body = F.struct("frame", *columns)
    agg = frames.groupBy(*keys).agg(
        F.min_by(body, order).alias("a"), F.max_by(body, order).alias("z"), F.min("match_time").alias("start_ms"),
        F.max("match_time").alias("end_ms"), F.max("ball_x_norm").alias("x_max_norm"), F.avg("ball_speed").alias("mean_speed"),
        F.count("*").alias("n_frames"),
        F.avg((F.col("possession_reason") == "balon_en_transito").cast("double")).alias("transit_share"))
    return agg.select(
        *keys, F.col("a.frame").alias("start_frame"), F.col("z.frame").alias("end_frame"), "start_ms", "end_ms",
        *[F.col(f"a.{c}").alias(f"{c}_start") for c in columns], *[F.col(f"z.{c}").alias(f"{c}_end") for c in columns],
        ((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)).alias("duration_s"),
        distance("a.ball_x_m", "a.ball_y_m", "z.ball_x_m", "z.ball_y_m").alias("path_m"),
        (F.col("z.ball_x_norm") - F.col("a.ball_x_norm")).alias("gain_m"), "x_max_norm", "mean_speed", "n_frames",
        "transit_share")


# ------------------------------------------------------------------------- events of a sequence

def events_in_sequence(seqs: DataFrame, events: DataFrame, keys=("match_id",), rules: SegmentRules = SegmentRules(),
                       id_columns=("cand_id",)) -> DataFrame:
    """Events of every sequence: by ``event_ids`` where the list is not empty, else by period and time.

    ``seqs``: keys, period, start_ms, end_ms, event_ids and ``id_columns``; ``events``: keys, period,
    match_time, event_id, … Both ways are equi joins (the second on time buckets)."""
    keys, ids = list(keys), list(id_columns)
    by_id = seqs.where(F.size("event_ids") > 0).select(
        *keys, *ids, F.explode(F.array_distinct("event_ids")).alias("event_id"))
    hit = events.join(by_id, [*keys, "event_id"]).select(*ids, *events.columns)
    by_time = seqs.where(F.coalesce(F.size("event_ids"), F.lit(0)) <= 0).select(*keys, "period", *ids, "start_ms", "end_ms")
    ranged = range_join(events, by_time, [*keys, "period"], "match_time", "start_ms", "end_ms", rules.bucket_ms)
    return hit.unionByName(ranged.select(*ids, *events.columns))


def chain_before(seqs: DataFrame, wanted: DataFrame, blocks: Blocks, keys=("match_id", "period"), seq_id: str = "cand_id",
                 rules: SegmentRules = SegmentRules(), payload=()) -> DataFrame:
    """Follows each wanted sequence back over its predecessors: the latest one ending at or before the
    chain's start with a small gap, until the chain reaches far enough back.

    The predecessor of every sequence is one as-of lookup. Jumps of 1, 2, 4, ... predecessors are made by joining the jumps with themselves, as long as
    any stays within the reach; each chain then takes the largest jumps that do, and one step more. The jumps taken are halved back into single steps to
    list the members, so rounds grow with the logarithm of the longest chain. Returns (keys, seq_id, chain_start, members) where
    ``members`` lists the ``payload`` structs of the sequences added."""
    keys = list(keys)
    # a sequence without length would be its own predecessor and never end the walk
    ended = seqs.where("end_ms > start_ms").select(*keys, "end_ms", F.col(seq_id).alias("prev_id"))
    before = asof(seqs.select(*keys, seq_id, "start_ms"), ended, keys, "start_ms", "end_ms", ["prev_id"], blocks,
                  tolerance=rules.chain_gap_ms, tie=F.col("prev_id"), prefix="")
    body = seqs.select(*keys, F.col(seq_id).alias("prev_id"), F.col("start_ms").alias("prev_start"),
                       F.struct(*payload, F.col(seq_id)).alias("member"))
    links = cut(before.join(body, [*keys, "prev_id"]).select(
        *keys, F.col(seq_id).alias("node"), "start_ms", "prev_id", "prev_start", "member"))

    def near(start, end):
        return F.col(start) - F.col(end) < rules.chain_reach_ms

    jumps = [cut(links.where(near("start_ms", "prev_start")).select(*keys, "node", "start_ms", F.col("prev_id").alias("to"), F.col("prev_start").alias("to_start")))]
    while not jumps[-1].isEmpty():
        on = jumps[-1].select(*keys, F.col("node").alias("to"), F.col("to").alias("further"), F.col("to_start").alias("further_start"))
        twice = jumps[-1].join(on, [*keys, "to"]).where(near("start_ms", "further_start"))
        jumps.append(cut(twice.select(*keys, "node", "start_ms", F.col("further").alias("to"), F.col("further_start").alias("to_start"))))
    jumps = [j.drop("start_ms") for j in jumps[:-1]]
    start = seqs.join(wanted, [*keys, seq_id], "left_semi").select(*keys, seq_id, F.col(seq_id).alias("node"), F.col("start_ms").alias("origin"))
    taken, walk = [], start
    for jump in reversed(jumps):
        tried = cut(walk.join(jump, [*keys, "node"], "left"))
        fits = F.coalesce(near("origin", "to_start"), F.lit(False))
        taken.append(tried.where(fits).select(*keys, seq_id, "node"))
        walk = tried.select(*keys, seq_id, F.when(fits, F.col("to")).otherwise(F.col("node")).alias("node"), "origin")
    # a jump of 2^k from a node is one of 2^(k-1) from it and one of 2^(k-1) from where that ends
    steps = walk.select(*keys, seq_id, "node")
    whole = None
    for k, some in zip(reversed(range(len(jumps))), taken):
        whole = some if whole is None else whole.union(some)
        if k:
            half = whole.join(jumps[k - 1], [*keys, "node"]).select(*keys, seq_id, F.col("to").alias("node"))
            whole = cut(whole.union(half))
    steps = steps if whole is None else steps.union(whole)
    added = steps.join(links, [*keys, "node"]).select(*keys, seq_id, F.col("prev_start").alias("chain_start"), "member")
    walked = start.select(*keys, seq_id, F.col("origin").alias("chain_start"), F.lit(None).cast(links.schema["member"].dataType).alias("member")).union(added)
    return walked.groupBy(*keys, seq_id).agg(
        F.min("chain_start").alias("chain_start"),
        F.array_sort(F.collect_list("member")).alias("members"), (F.count("*") - 1).alias("n_added"))


def extend_to_terminal(seqs: DataFrame, closers: DataFrame, blocks: Blocks, keys=("match_id", "period"),
                       rules: SegmentRules = SegmentRules()) -> DataFrame:
    """Moves the end to just after the first closing event within the window and before the next
    sequence. ``closers``: keys, match_time, close_reason (only events that may close)."""
    starts = seqs.select(*keys, F.col("start_ms").alias("__s"))
    out = asof_many(seqs, [
        Side(starts, "__s", [], "forward", True, prefix="__n_"),
        Side(closers.select(*keys, "match_time", "close_reason"), "match_time", ["close_reason"], "forward", True,
             tie=F.col("close_reason"), prefix="__c_")], list(keys), "end_ms", blocks)
    limit = F.least(F.col("end_ms") + rules.terminal_ms, F.col("__n_time") - 1)
    closes = (limit > F.col("end_ms")) & (F.col("__c_time") <= limit)
    return out.withColumns({
        "end_provider_ms": F.col("end_ms"),
        "close_reason": F.when(closes, F.col("__c_close_reason")).otherwise(F.lit("cierre_bepro")),
        "end_ms": F.when(closes, F.least(F.col("__c_time") + rules.terminal_buffer_ms, limit)).otherwise(F.col("end_ms")),
    }).drop("__c_time", "__c_close_reason", "__n_time")


def closing_events(events: DataFrame, teams: DataFrame) -> DataFrame:
    """Events that may end a rival attack: terminal types of the other team, or a rival shot."""
    e = events.join(teams, "match_id").where(F.col("team_id").isNotNull())
    own = F.col("team_id") != F.col("rival_team")
    shot = ~own & has_event("event_types", ["shot"])
    return e.where((own & has_event("event_types", TERMINAL_TYPES)) | shot).select(
        "match_id", "period", "match_time",
        F.when(own, "cierre_recuperacion_propia").otherwise("cierre_tiro_rival").alias("close_reason"))


def first_pass(events: DataFrame, keys, attacks_high: str = "attacks_high", rules: SegmentRules = SegmentRules()) -> DataFrame:
    """Per sequence the first event's types and, if it is a pass, its length and forward gain."""
    order = F.struct("match_time", "event_id")
    first = events.groupBy(*keys).agg(F.min_by(F.struct("event_types", "x", "y", "to_x", "to_y", attacks_high),
                                               order).alias("f"))
    passes = has_event("f.event_types", ["pass"])
    dx, dy = (F.col("f.to_x") - F.col("f.x")) * rules.length, (F.col("f.to_y") - F.col("f.y")) * rules.width
    known = passes & dx.isNotNull() & dy.isNotNull()
    return first.select(
        *keys, F.col("f.event_types").alias("first_types"), passes.alias("first_pass"),
        has_event("f.event_types", REGAIN_TYPES).alias("first_regain"),
        F.when(known, F.sqrt(dx * dx + dy * dy)).otherwise(F.lit(0.0)).alias("pass_m"),
        F.when(known, F.when(F.col(f"f.{attacks_high}"), dx).otherwise(-dx)).otherwise(F.lit(0.0)).alias("pass_gain_m"))


def sequence_events_summary(ev: DataFrame, keys, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """Counts, flags and reach of the events of each sequence. ``ev`` carries ``attacks_high``."""
    L = F.lit(rules.length)

    def norm(c):
        return F.when(F.col("attacks_high"), F.col(c) * L).otherwise(L - F.col(c) * L)

    base = ev.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.max(has_event("event_types", ["shot"])).alias("has_shot"),
        F.max(F.coalesce(F.col("event_text").rlike("goal|gol"), F.lit(False))).alias("text_goal"),
        F.max(F.coalesce(F.col("event_text").rlike("shotontarget|shot_on_target|goal|gol"), F.lit(False))).alias("text_target"),
        F.min(F.when(F.col("setpiece_type").isNotNull(), F.col("match_time"))).alias("setpiece_ms"),
        F.max(F.greatest(norm("x"), norm("to_x"))).alias("events_x_max"))
    after = ev.join(base.select(*keys, "setpiece_ms").where("setpiece_ms IS NOT NULL"), keys)
    post = after.groupBy(*keys).agg(F.count_if(F.col("match_time") >= F.col("setpiece_ms")).alias("n_after_setpiece"))
    return base.join(post, keys, "left").join(first_pass(ev, keys, rules=rules), keys, "left")


# ----------------------------------------------------------------------------------- path I

def sequence_metrics(seqs: DataFrame, frames: DataFrame, keys=("match_id", "period"), seq_id: str = "cand_id",
                     rules: SegmentRules = SegmentRules(), blocks: Blocks = TRACKING_BLOCKS) -> DataFrame:
    """Ball geometry of every interval over the frames inside it that show the ball."""
    ball = frames.where(F.col("ball_x_m").isNotNull() & F.col("ball_y_m").isNotNull())
    columns = ["ball_x_m", "ball_y_m", "ball_x_norm", "ball_y_norm"]
    speed = F.col("ball_speed").cast("double")
    totals = range_totals(ball, seqs, list(keys), [seq_id], "match_time", "start_ms", "end_ms", ["frame"], ["match_time", "frame", *columns],
                          {"n_frames": F.lit(1).cast("long"), "__known": speed.isNotNull().cast("long")}, {"__speed": F.coalesce(speed, F.lit(0.0))},
                          {"x_max_norm": F.col("ball_x_norm")}, blocks)
    agg = totals.withColumnsRenamed({"first": "a", "last": "z"}).withColumn("mean_speed", F.try_divide("__speed", "__known"))
    return agg.where("n_frames >= 2").select(
        *keys, seq_id, F.col("a.frame").alias("start_frame"), F.col("z.frame").alias("end_frame"),
        *[F.col(f"a.{c}").alias(f"{c}_start") for c in columns], *[F.col(f"z.{c}").alias(f"{c}_end") for c in columns],
        distance("a.ball_x_m", "a.ball_y_m", "z.ball_x_m", "z.ball_y_m").alias("path_m"),
        (F.col("z.ball_x_norm") - F.col("a.ball_x_norm")).alias("gain_m"), "x_max_norm", "mean_speed", "n_frames")


def preferred_metrics(df: DataFrame) -> DataFrame:
    """Provider distance, progress and passes where given; with a shot the larger of both sources."""
    gain = F.greatest(F.col("gain_m"), F.lit(0.0))
    shot = F.coalesce("has_shot_first", F.lit(False))
    dist, prog = F.coalesce("total_distance", "path_m"), F.coalesce("progress_distance", gain)
    return df.withColumns({
        "action_m": F.when(shot, F.greatest(dist, F.col("path_m"))).otherwise(dist),
        "action_gain_m": F.when(shot, F.greatest(prog, gain)).otherwise(prog),
        "n_passes": F.coalesce(F.col("num_passes").cast("int"), F.lit(0))})


def classify_sequence(r: SegmentRules = SegmentRules()) -> Column:
    """Decision table of path I as one expression: struct(keep, kind, reason)."""
    c, L = F.col, r.length

    def keep(kind, reason):
        return F.struct(F.lit(True).alias("keep"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
                        F.lit(reason).alias("reason"))

    def drop(reason):
        return F.struct(F.lit(False).alias("keep"), F.lit("descartada").alias("kind"), F.lit(reason).alias("reason"))

    dur, n, dist, prog = c("duration_s"), F.coalesce(c("n_events"), F.lit(0)), c("action_m"), c("action_gain_m")
    passes, direction = c("n_passes"), F.coalesce(c("progress_direction"), F.lit(""))
    shot = F.coalesce(c("has_shot"), F.lit(False))
    goal, target = shot & F.coalesce(c("text_goal"), F.lit(False)), shot & F.coalesce(c("text_target"), F.lit(False))
    gain = F.greatest(c("gain_m"), F.lit(0.0))
    reach = F.coalesce(F.greatest(c("x_max_norm"), c("events_x_max")), F.lit(0.0))
    regain, pass1 = F.coalesce(c("first_regain"), F.lit(False)), F.coalesce(c("first_pass"), F.lit(False))
    setpiece = c("setpiece_ms").isNotNull()
    after_s = (c("end_ms") - c("setpiece_ms")) / F.lit(1000.0)
    alive = ((c("n_after_setpiece") >= r.setpiece_events) & (after_s >= r.setpiece_seconds)
             & ((dist >= r.direct_path_m) | (prog >= r.direct_gain_m) | (passes >= 2)))
    harmless = (direction == "backward") & (prog < r.direct_gain_m)
    quick = (dur <= r.transition_seconds) & ((gain >= r.direct_gain_m) | (c("x_max_norm") >= r.direct_x * L)
                                             | ((direction == "forward") & (prog >= r.direct_gain_m)))
    light = ~shot & (c("provider_s") <= 3.0) & (n <= 2) & (passes <= 2)
    threat = (reach >= r.light_x * L) | ((gain >= r.light_gain_m) & (reach >= 0.5 * L))
    busy = (passes >= 2) | (n >= 4)
    built = (n >= r.built_events) & (dur >= r.built_seconds)
    by_time = F.when(dur <= r.transition_seconds, "transicion_rapida").otherwise("ataque_elaborado")
    long_pass = (F.coalesce(c("pass_m"), F.lit(0.0)) >= r.direct_path_m) & (c("pass_gain_m") >= r.direct_gain_m)
    direct = pass1 & (passes <= 2) & (dist >= r.direct_path_m) & (prog >= r.direct_gain_m) & (direction == "forward")
    return (
        F.when(dur < r.min_seconds, drop("microaccion_menos_1s"))
        .when(dur > r.max_seconds, drop("secuencia_demasiado_larga"))
        .when(setpiece & alive & ~harmless, keep("balon_parado_con_continuidad", "setpiece_con_continuidad_bepro"))
        .when(setpiece, drop("setpiece_sin_continuidad_posterior"))
        .when(regain & light & ~threat, drop("recuperacion_ligera_sin_amenaza_terminal"))
        .when(regain & (dur >= 2.0) & (n >= 2) & (dist >= r.transition_path_m) & quick,
              keep("transicion_rapida", "origen_recuperacion_rival"))
        .when(regain & built & (dist >= r.min_path_m) & busy, keep("ataque_elaborado", "recuperacion_con_posesion_elaborada"))
        .when(regain, drop("recuperacion_sin_continuidad_ofensiva"))
        .when(goal & (dur >= 1.0) & (n >= 2), keep(by_time, "finalizacion_gol_con_continuidad"))
        .when(target & (dur >= 2.0) & (n >= 2), keep(by_time, "tiro_a_puerta_con_continuidad"))
        .when((long_pass | direct) & ((n >= 2) | (dur >= 2.0)), keep("juego_directo", "primer_pase_largo_progresivo"))
        .when(built & (dist >= r.min_path_m) & busy, keep("ataque_elaborado", "posesion_bepro_elaborada"))
        .when(built, drop("posesion_larga_sin_recorrido_ofensivo"))
        .otherwise(drop("sin_desarrollo_ofensivo_evaluable")))


def from_provider(seqs: DataFrame, frames: DataFrame, events: DataFrame, teams: DataFrame, directions: DataFrame,
                  rules: SegmentRules = SegmentRules(), blocks: Blocks = TRACKING_BLOCKS) -> DataFrame:
    """Path I: every provider sequence of the rival with its metrics and the keep decision."""
    rival = teams.select("match_id", F.col("rival_team").alias("__rival"))
    seqs = seqs.join(rival, "match_id").where((F.col("team_id") == F.col("__rival")) & (F.col("end_ms") > F.col("start_ms")))
    seqs = seqs.drop("__rival").withColumn("cand_id", F.col("provider_id"))
    mine = events.join(rival, "match_id").where(F.col("team_id") == F.col("__rival")).drop("__rival", "player_name", "team_name")
    pick = ["match_id", "period", "cand_id", "start_ms", "end_ms", "event_ids"]
    first = events_in_sequence(seqs.select(*pick), mine, rules=rules)
    shots = first.where(has_event("event_types", ["shot"])).select("match_id", "cand_id").distinct()
    seqs = cut(seqs.join(shots.withColumn("has_shot_first", F.lit(True)), ["match_id", "cand_id"], "left").withColumn(
        "has_shot_first", F.coalesce("has_shot_first", F.lit(False))))
    with_shot = seqs.where("has_shot_first")
    chain = chain_before(seqs, with_shot.select(*SEQ), blocks, rules=rules, payload=("event_ids",))
    chained = with_shot.join(chain, SEQ, "left")
    moved = F.col("chain_start") < F.col("start_ms")
    all_ids = F.array_distinct(F.concat("event_ids", F.flatten(F.col("members.event_ids"))))
    chained = chained.select(
        *[c for c in seqs.columns if c not in ("start_ms", "event_ids")], F.col("start_ms").alias("start_provider_ms"),
        F.when(moved, F.col("chain_start")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(moved & (F.size(all_ids) > 0), all_ids).otherwise(F.col("event_ids")).alias("event_ids"),
        F.when(moved & (F.size(all_ids) > 0), None).otherwise(F.col("start_ms")).cast("double").alias("from_ms"),
        F.col("end_ms").alias("end_provider_ms"), F.lit("cierre_bepro").alias("close_reason"))
    # next starts come from all rival sequences, closing events only from the rest
    ext = extend_to_terminal(seqs, closing_events(events, teams), blocks, rules=rules).where(~F.col("has_shot_first"))
    longer = F.col("end_ms") > F.col("end_provider_ms")
    ext = ext.withColumns({
        "start_provider_ms": F.col("start_ms"), "from_ms": F.col("start_ms").cast("double"),
        "event_ids": F.when(longer, F.array().cast("array<string>")).otherwise(F.col("event_ids"))})
    both = cut(chained.unionByName(ext))
    sel = both.select("match_id", "period", "cand_id", F.coalesce("from_ms", "start_ms").alias("start_ms"), "end_ms", "event_ids")
    found = events_in_sequence(sel, mine, rules=rules).drop("period")
    high = both.select(*SEQ).join(directions, ["match_id", "period"], "left").join(
        directions.select("match_id").distinct().withColumn("__k", F.lit(True)), "match_id", "left").select(
        "match_id", "cand_id", F.coalesce("attacks_high", F.col("__k"), F.col("period") == 0).alias("attacks_high"))
    summary = sequence_events_summary(found.join(high, ["match_id", "cand_id"]), ["match_id", "cand_id"], rules)
    full = (both.join(sequence_metrics(both, frames, rules=rules, blocks=blocks), SEQ).join(summary, ["match_id", "cand_id"], "left")
            .withColumns({"duration_s": (F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0),
                          "provider_s": (F.col("end_provider_ms") - F.col("start_provider_ms")) / F.lit(1000.0)}))
    full = preferred_metrics(full).withColumn("__v", classify_sequence(rules))
    return full.withColumns({"keep": F.col("__v.keep"), "sequence_type": F.col("__v.kind"),
                             "keep_reason": F.col("__v.reason"), "n_rival_events": F.coalesce("n_events", F.lit(0)),
                             "has_setpiece": F.col("setpiece_ms").isNotNull(),
                             "origin": F.lit("bepro_sequences")}).drop("__v")


# ----------------------------------------------------------------------------------- path II

def first_movement(frames: DataFrame, keys, blocks: Blocks = TRACKING_BLOCKS, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """First frame whose step from the previous one exceeds the threshold, and how far the ball then is
    from the first point. ``frames``: keys, frame, match_time, ball_x_m, ball_y_m (ball known)."""
    keys = list(keys)
    moved = ordered(frames, keys, ["match_time", "frame"], blocks, lag={"__p": F.struct("ball_x_m", "ball_y_m")})
    step = distance("ball_x_m", "ball_y_m", "__p.ball_x_m", "__p.ball_y_m")
    order = F.struct("match_time", "frame")
    body = F.struct("match_time", "ball_x_m", "ball_y_m")
    out = moved.groupBy(*keys).agg(
        F.count("*").alias("n_ball"), F.min_by(body, order).alias("a"), F.max("match_time").alias("last_ms"),
        F.min_by(body, F.when(step > rules.kick_m, order)).alias("m"))
    return out.select(*keys, "n_ball", F.col("m.match_time").alias("active_ms"), "last_ms",
                      distance("a.ball_x_m", "a.ball_y_m", "m.ball_x_m", "m.ball_y_m").alias("kick_m"))


def classify_block(r: SegmentRules = SegmentRules()) -> Column:
    """Decision table of path II: struct(keep, kind, reason)."""
    c = F.col

    def out(keep, kind, reason):
        return F.struct(F.lit(keep).alias("keep"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))

    def drop(reason):
        return out(False, "descartada", reason)

    stand = "balon_parado_con_continuidad"
    dur, n, path, speed, gain = c("duration_s"), c("n_rival_events"), c("path_m"), c("mean_speed"), c("gain_m")
    sp, active_s = c("setpiece_ms").isNotNull(), c("active_s")
    fast = (n >= r.min_events) & (dur >= r.min_seconds) & (speed >= r.min_speed) & (gain >= r.direct_gain_m)
    quick_after = ((active_s >= r.min_seconds) & (c("post_path_m") >= r.direct_path_m) & (c("post_speed") >= r.min_speed)
                   & (c("post_gain_m") >= r.direct_gain_m))
    return (
        F.when(dur < r.min_seconds, drop("microaccion_menos_1s"))
        .when(dur > r.max_seconds, drop("secuencia_demasiado_larga"))
        .when(sp & (F.coalesce(c("n_ball"), F.lit(0)) < 2), drop("setpiece_sin_movimiento_balon"))
        .when(sp & c("active_ms").isNull(), drop("setpiece_balon_parado_sin_saque_real"))
        .when(sp & ((active_s < r.setpiece_seconds) | (c("n_post_events") < r.setpiece_events)),
              drop("setpiece_sin_continuidad_posterior"))
        .when(sp & (c("post_path_m") >= r.min_path_m),
              F.when(c("kick_m") <= r.short_kick_m, out(True, stand, "setpiece_corto_con_elaboracion"))
              .otherwise(out(True, stand, "setpiece_largo_con_elaboracion")))
        .when(sp & quick_after, out(True, stand, "setpiece_con_accion_directa_posterior"))
        .when(sp, drop("setpiece_sin_continuidad"))
        .when(F.coalesce(c("early_regain"), F.lit(False)) & fast & (dur <= r.transition_seconds)
              & (path >= r.transition_path_m), out(True, "transicion_rapida", "recuperacion_y_amenaza"))
        .when((n >= r.built_events) & (dur >= r.built_seconds) & (path >= r.min_path_m),
              out(True, "ataque_elaborado", "elaboracion_juego_fluido"))
        .when(fast & (path >= r.direct_path_m), out(True, "juego_directo", "desplazamiento_vertical_claro"))
        .otherwise(drop("ruido_sin_continuidad_ni_progresion")))


def from_tracking(frames: DataFrame, events: DataFrame, teams: DataFrame, rules: SegmentRules = SegmentRules(),
                  blocks: Blocks = TRACKING_BLOCKS) -> DataFrame:
    """Path II: possession blocks of the rival with metrics and the keep decision."""
    rival = teams.select("match_id", F.col("rival_team").alias("__rival"))
    held = extend_possession(frames, blocks, rules=rules).join(rival, "match_id")
    numbered = cut(possession_blocks(held, F.col("team_extended") == F.col("__rival"), blocks, rules=rules))
    mine = numbered.where("is_rival")
    blocks_ = block_metrics(mine).withColumn("cand_id", F.col("block_no").cast("string")).withColumn(
        "event_ids", F.array().cast("array<string>"))
    feed = events.join(rival, "match_id").withColumn("__mine", F.col("team_id") == F.col("__rival"))
    ev = range_join(feed.select("match_id", "period", "match_time", "event_id", "event_types", "setpiece_type", "__mine"),
                    blocks_.select(*SEQ, "start_ms", "end_ms"), ["match_id", "period"], "match_time", "start_ms", "end_ms",
                    rules.bucket_ms)
    own = F.coalesce("__mine", F.lit(False))
    counts = ev.groupBy(*SEQ).agg(
        F.count("*").alias("n_events"), F.count_if(own).alias("n_rival_events"),
        F.min(F.when(own & F.col("setpiece_type").isNotNull(), F.col("match_time"))).alias("setpiece_ms"),
        F.max(own & F.array_contains("event_types", "recovery")
              & (F.col("match_time") <= F.col("start_ms") + rules.regain_ms)).alias("early_regain"))
    base = cut(blocks_.join(counts, SEQ, "left").fillna(0, ["n_events", "n_rival_events"]))
    stood = base.where("setpiece_ms IS NOT NULL").select(*SEQ, F.col("setpiece_ms").alias("__from"), F.col("end_ms").alias("__to"))
    ball = frames.where("ball_x_m IS NOT NULL AND ball_y_m IS NOT NULL").select(
        "match_id", "period", "frame", "match_time", "ball_x_m", "ball_y_m", "ball_x_norm", "ball_speed")
    post = range_join(ball, stood, ["match_id", "period"], "match_time", "__from", "__to", rules.bucket_ms).drop("__from", "__to")
    post = cut(post)
    kick = cut(first_movement(post, SEQ, blocks, rules))
    active = post.join(kick.select(*SEQ, "active_ms").where("active_ms IS NOT NULL"), SEQ).where("match_time >= active_ms")
    order, body = F.struct("match_time", "frame"), F.struct("ball_x_m", "ball_y_m", "ball_x_norm")
    stretch = active.groupBy(*SEQ).agg(F.min_by(body, order).alias("a"), F.max_by(body, order).alias("z"),
                                       F.avg("ball_speed").alias("s"), F.count("*").alias("k"))
    some = F.col("k") >= 2
    stretch = stretch.select(
        *SEQ, F.when(some, distance("a.ball_x_m", "a.ball_y_m", "z.ball_x_m", "z.ball_y_m")).otherwise(0.0).alias("post_path_m"),
        F.when(some, F.col("z.ball_x_norm") - F.col("a.ball_x_norm")).otherwise(0.0).alias("post_gain_m"),
        F.when(some, F.col("s")).otherwise(0.0).alias("post_speed"))
    later = ev.where(own).join(kick.select(*SEQ, "active_ms"), SEQ).where("match_time >= active_ms").groupBy(*SEQ).agg(
        F.count("*").alias("n_post_events"))
    full = base.join(kick, SEQ, "left").join(stretch, SEQ, "left").join(later, SEQ, "left").fillna(0, ["n_post_events"])
    full = full.withColumn("active_s", (F.col("last_ms") - F.col("active_ms")) / F.lit(1000.0))
    full = full.withColumn("__v", classify_block(rules))
    return full.withColumns({"keep": F.col("__v.keep"), "sequence_type": F.col("__v.kind"), "keep_reason": F.col("__v.reason"),
                             "has_setpiece": F.col("setpiece_ms").isNotNull(),
                             "origin": F.lit("tracking_poseedor")}).drop("__v")


# ------------------------------------------------------------------------------ both paths

KEPT_COLUMNS = ["match_id", "period", "provider_id", "start_frame", "end_frame", "start_ms", "end_ms", "end_provider_ms",
                "close_reason", "duration_s", "ball_x_m_start", "ball_y_m_start", "ball_x_m_end", "ball_y_m_end",
                "ball_x_norm_start", "ball_y_norm_start", "ball_x_norm_end", "ball_y_norm_end", "gain_m", "x_max_norm",
                "path_m", "action_m", "action_gain_m", "n_passes", "progress_direction", "mean_speed", "n_frames",
                "n_events", "n_rival_events", "has_setpiece", "sequence_type", "keep_reason", "origin"]


def number_sequences(seqs: DataFrame, order: list[Column], match_key: str = "match_id", name: str = "seq_id",
                     blocks: Blocks = Blocks.every(600_000)) -> DataFrame:
    """Ids 1..n per match in the given order (numeric order keys, the most significant first)."""
    names = [f"__o{i}" for i in range(len(order))]
    keyed = seqs.withColumns(dict(zip(names, order)))
    return ordered(keyed, [match_key], names, blocks, running={name: F.lit(1)}).drop(*names)


def segment_sequences(frames: DataFrame, events: DataFrame, provider: DataFrame, teams: DataFrame,
                      rules: SegmentRules = SegmentRules(), blocks: Blocks = TRACKING_BLOCKS) -> DataFrame:
    """Kept sequences of all matches, numbered per match. Long steps are written to the checkpoint folder."""
    rival = teams.select("match_id", F.col("rival_team").alias("__rival"))
    dirs = attack_direction(events.join(rival, "match_id").where(F.col("team_id") == F.col("__rival")))
    sized = {"ball_x_norm": ("ball_x_m", rules.length), "ball_y_norm": ("ball_y_m", rules.width)}
    dirs = cut(dirs)
    frames = cut(mirror_by_direction(frames, dirs, sized))
    one = cut(from_provider(provider, frames, events, teams, dirs, rules, blocks).where("keep"))
    rest = frames.join(one.select("match_id").distinct(), "match_id", "left_anti")
    two = from_tracking(cut(rest), events, teams, rules, blocks).where("keep")
    types = {f.name: f.dataType for f in one.schema}

    def shape(df):
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in KEPT_COLUMNS])

    kept = shape(one).unionByName(shape(two))
    # one order key: period first, then start time
    place = F.col("period") * F.lit(1e10) + F.col("start_ms")
    return number_sequences(cut(kept), [place, F.coalesce("provider_id", F.lit("")), F.col("start_frame")])


def tag_tracking(tracking: DataFrame, seqs: DataFrame, blocks: Blocks = TRACKING_BLOCKS,
                 keys=("match_id", "period"), seq_id: str = "seq_id") -> DataFrame:
    """Adds ``seq_id``: the largest id among the sequences containing the row, NULL outside all."""
    out = best_covering(tracking.drop(seq_id), seqs, list(keys), "match_time", "start_ms", "end_ms", [F.col(seq_id)],
                        [seq_id], blocks)
    return out.withColumnRenamed(f"m_{seq_id}", seq_id)
