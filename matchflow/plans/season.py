"""The whole analysis of many matches, and the published tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH
from ..lineage import cut
from ..operators import (align, attack, cluster as cl, defence, detail, events as evs, indices as ix, reports, rollups as ru, segment as sg,
                         threat, timeline as tl, tracking as tr, trajectory as tj)
from ..operators.ordered import Blocks

MATCH = ["match_id"]
SEQ = ["match_id", "seq_id"]


@dataclass
class SeasonResult:
    """Tables of the analysis: those used by several later steps are written by ``keep`` as the analysis runs, the rest is lazy."""

    teams: DataFrame
    tracking: DataFrame
    events: DataFrame
    shots: DataFrame
    sequences: DataFrame
    trajectories: DataFrame
    features: DataFrame
    clusters: DataFrame
    indexed: DataFrame
    detail: DataFrame
    labels: DataFrame
    totals: DataFrame
    model: PipelineModel | None = None
    extra: dict = field(default_factory=dict)


def prepare_tracking(raw: DataFrame, events: DataFrame, blocks: Blocks) -> DataFrame:
    """Bucketed, moved, aligned with the events and with a possessor per row."""
    small = cut(tr.downsample(raw))
    moved = cut(tr.ball_kinematics(cut(tr.player_kinematics(small, blocks)), blocks))
    aligned = align.recalibrate(moved, events, blocks=blocks)
    return tr.detect_possession(aligned)


def analyse_matches(raw_tracking: DataFrame, raw_events: DataFrame, provider: DataFrame, *, own_team: int | None = None,
                    model: PipelineModel | None = None, n_clusters: int | None = None, restarts: int = 20,
                    blocks: Blocks = tr.TRACKING_BLOCKS, keep=None) -> SeasonResult:
    """Tracking, events and provider sequences of any number of matches to sequence indices.

    ``keep`` (a function DataFrame -> DataFrame, e.g. write and reread a silver table) is applied to every
    table used by several later steps; by default they are written to the checkpoint folder. With a stored cluster model the model is applied, otherwise one is
    fitted over all sequences of the run."""
    keep = keep or cut
    teams = tr.own_and_rival(tr.drop_incomplete(tr.coerce_numeric(raw_tracking, (), ["match_id", "team_id"]), ["team_id"]), own_team=own_team)
    teams = keep(teams)
    events = keep(evs.key_events(raw_events))
    tracking = keep(prepare_tracking(raw_tracking, events, blocks))
    shots = keep(evs.official_shots(raw_events, teams))
    frames = tr.frame_table(tracking)
    seqs = keep(sg.segment_sequences(keep(frames), events, provider, teams, blocks=blocks))
    tagged = keep(sg.tag_tracking(tracking, seqs, blocks).where("seq_id IS NOT NULL"))

    ball = keep(tj.sequence_frames(tagged))
    traj = keep(tj.trajectories(ball, blocks))
    features = keep(tj.tactical_features(seqs, tj.ball_amplitude(tagged)))
    frame = keep(cl.model_frame(traj, features))
    dims = 40 + len(cl.FEATURES)
    model_k = None if model is None else cl.model_size(model)
    if model is None:
        if n_clusters is None:
            n_clusters = _choose_k(frame, dims, restarts)
        if n_clusters > 1:
            model, _ = cl.fit_pipeline(frame, n_clusters, restarts=restarts)
    clusters = (cl.apply_model(frame, model) if model is not None else frame.withColumn("cluster", F.lit(0))).select(*SEQ, "cluster")
    clusters = keep(clusters)

    assigned = keep(attack.assign_shots(shots, seqs, blocks))
    summary = keep(attack.attack_summary(tagged, seqs, assigned, clusters))
    xt = threat.sequence_threat(ball, blocks)
    own = teams.select("match_id", "own_team")
    rows = tagged.join(own, "match_id")
    mine = rows.where(F.col("team_id") == F.col("own_team"))
    profile = ix.idd_inputs(defence.defensive_profile(mine, blocks))
    control = defence.pitch_control(rows, F.col("team_id") == F.col("own_team"), blocks)
    base = index_inputs(profile, control, xt, summary)
    base = keep(base.withColumn("finish_score", threat.finish_score()))
    scored = keep(ix.ipo(ix.idd(base, MATCH), MATCH))
    indexed = ix.percentile_category(scored, MATCH, {"idd": "idd_category", "ipo": "ipo_category"})
    indexed = keep(indexed)
    validation = ru.possession_validation(tagged, teams)
    detail_ = keep(detail.sequence_detail(indexed, seqs, validation))
    labels = ru.taxonomy_profile(summary, normalised_points(tagged, clusters))
    totals = stage_totals(raw_tracking, tracking, raw_events, seqs, shots, summary, teams, model_k)
    return SeasonResult(teams, tracking, events, shots, seqs, traj, features, clusters, indexed, detail_, labels, totals, model,
                        {"tagged": tagged, "summary": summary, "assigned": assigned, "ball": ball})


SUMMARY = ("cluster", "shot", "on_target", "goal", "xg", "cross", "loss", "x_start", "x_end", "y_start", "y_end", "shot_ms", "gap_ms", "assignment",
           "amplitude_m", "gain_x_m")


def index_inputs(profile: DataFrame, control: DataFrame, xt: DataFrame, summary: DataFrame, keys=SEQ) -> DataFrame:
    """What the indices need, one row per sequence with a defensive profile: its control, threat and summary where there are any."""
    keys = list(keys)
    return profile.join(control, keys, "left").join(xt, keys, "left").join(summary.select(*keys, *SUMMARY), keys, "left")


def _choose_k(frame: DataFrame, dims: int, restarts: int) -> int:
    diag = cl.kmeans_diagnostics(frame, n_dims=dims, restarts=restarts)
    best = cl.select_k(cl.elbow_strength(diag), frame.count()).where("chosen").select("k").first()
    return best["k"] if best else 1


def normalised_points(tagged: DataFrame, clusters: DataFrame, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Ball places of all rows of clustered sequences, the second period mirrored."""
    rows = tagged.select(*SEQ, "period", "ball_x_m", "ball_y_m").join(clusters, SEQ)
    first = F.col("period") == 0
    return rows.withColumns({
        "ball_x_norm": F.when(first, F.col("ball_x_m")).otherwise(F.lit(length) - F.col("ball_x_m")),
        "ball_y_norm": F.when(first, F.col("ball_y_m")).otherwise(F.lit(width) - F.col("ball_y_m"))})


# fixed values: where the clusters of a match come from
STORED_MODEL, OWN_MODEL = "global", "partido_auto"


def stage_totals(raw_tracking, tracking, raw_events, seqs, shots, summary, teams, model_k: int | None = None) -> DataFrame:
    """Rows per stage and match, with the team ids: sequences detected and kept (two ball points or more), kept ones
    with a shot, and the clusters among the kept ones. ``cluster_scope`` tells a stored model (of ``model_k`` clusters) from one fitted in
    the run, whose size for a match is the number of its clusters."""
    on_target = shots.where("on_target = 1")
    kinds = summary.groupBy("match_id").agg(F.count_distinct("cluster").alias("typologies"))
    counts = ru.match_summary({
        "tracking_raw": raw_tracking, "tracking_bucketed": tracking, "events_raw": raw_events, "sequences_detected": seqs, "sequences": summary,
        "shots_rival": shots, "shots_on_target_rival": on_target, "shots_assigned": summary.where("shot = 1")})
    out = counts.join(kinds, "match_id", "left").fillna(0, ["typologies"]).join(teams, "match_id", "left")
    return out.withColumns({"cluster_scope": F.lit(OWN_MODEL if model_k is None else STORED_MODEL),
                            "n_clusters_model": F.col("typologies") if model_k is None else F.lit(model_k).cast("long")})


def published_tables(r: SeasonResult) -> dict[str, DataFrame]:
    """The published tables of all matches."""
    d = r.detail
    seqs = r.indexed.join(r.sequences.select(*SEQ, "duration_s"), SEQ, "left")
    patterns = ru.pattern_table(seqs)
    return {
        "detail": d,
        "kpis": ru.match_kpis(seqs, r.totals, patterns),
        "cluster_summary": ru.cluster_summary(seqs, labels=r.labels),
        "risk_summary": ru.risk_summary(seqs),
        "category_matrix": ru.category_matrix(seqs),
        "ranking": ru.ranking(seqs.select(*SEQ, "cluster", "ipo", "idd", "ipo_category", "idd_category", "cause", "finish_score", "shot", "on_target")),
        "damage_without_disorder": ru.extremes_top(seqs.select(*SEQ, "cluster", "idd", "ipo", "cause", "shot", "on_target", "idd_category", "ipo_category"), "damage"),
        "chaos_unpunished": ru.extremes_top(seqs.select(*SEQ, "cluster", "idd", "ipo", "cause", "shot", "on_target", "idd_category", "ipo_category"), "chaos"),
        "damage_causes": ru.damage_causes(seqs),
        "damage_zones": ru.damage_zones(seqs),
        "light_trajectories": tj.light_trajectories(r.extra["tagged"], r.extra["summary"]),
        "threat_by_cluster": threat.threat_by_cluster(seqs),
        "patterns": patterns,
        "report": reports.match_report_text(r.totals, patterns),
        "report_markdown": reports.match_report_markdown(r.totals, ru.match_kpis(seqs, r.totals, patterns), ru.risk_summary(seqs),
                                                         ru.damage_causes(seqs), ru.damage_zones(seqs)),
        "metadata": metadata(r),
    }


def metadata(r: SeasonResult) -> DataFrame:
    """One row per match: teams, names, counts and the time of the run."""
    from ..sources.catalogue import initials, team_names
    names = team_names(r.extra["tagged"].select("match_id", "team_id", "team_name"), ("match_id",)) if "team_name" in r.extra["tagged"].columns \
        else r.teams.select("match_id", F.explode(F.array("own_team", "rival_team")).alias("team_id")).withColumn("team_name", F.col("team_id").cast("string"))
    own = names.select("match_id", F.col("team_id").alias("own_team"), F.col("team_name"))
    rival = names.select("match_id", F.col("team_id").alias("rival_team"), F.col("team_name").alias("rival"))
    out = r.totals.join(own, ["match_id", "own_team"], "left").join(rival, ["match_id", "rival_team"], "left")
    return out.withColumns({"team_id": F.col("own_team"), "rival_initials": initials(F.coalesce("rival", F.lit("Rival"))),
                            "modified": F.current_timestamp()})


def global_clusters(results: list[tuple[DataFrame, DataFrame]], k: int | None = None, k_range=(2, 10), restarts: int = 20):
    """Cluster model over the trajectories and features of many runs: (frame, diagnostics, model, assignments).
    Without ``k`` only the diagnostics are made; a person picks k from them."""
    traj, feats = results[0]
    for t, f in results[1:]:
        traj, feats = traj.unionByName(t), feats.unionByName(f)
    frame = cl.model_frame(traj, feats)
    dims = 40 + len(cl.FEATURES)
    diag = cl.elbow_strength(cl.kmeans_diagnostics(frame, n_dims=dims, k_min=k_range[0], k_max=k_range[1], restarts=restarts))
    if k is None:
        return frame, diag, None, None
    model, _ = cl.fit_pipeline(frame, k, restarts=restarts)
    return frame, diag, model, cl.apply_model(frame, model).select(*SEQ, "cluster").withColumn("n_clusters", F.lit(k))
