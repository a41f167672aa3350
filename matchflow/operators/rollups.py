"""Roll-ups of the sequence table. ``keys`` is the match (and team) key; group sizes stay small
because everything is aggregated before any window or sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import flag, num, ratio
from ..functions.geometry import LANE_CODES, LANE_NAMES, PITCH_LENGTH, PITCH_WIDTH, lane_y5, zone_x4
from ..functions.labels import (CATEGORIES, PATTERN_BASE, MINUTE_LABELS, NO_ZONE, RISK_LEVELS, lane_label, minute_bin, rank_of,
                                risk_bin, typology_label, zone_label, zone_short_label)
from .ordered import first_rows
from .quantiles import group_stats, mode_table, percentile_table

HIGH = ("muy_alta", "critica")
MATCH = ("match_id",)


def _sum(c: str, name: str | None = None) -> Column:
    return F.sum(flag(c)).alias(name or c)


# ------------------------------------------------------------------------------------ clusters

def taxonomy_profile(seqs: DataFrame, ball: DataFrame, keys=MATCH, cluster: str = "cluster", length: float = PITCH_LENGTH,
                     width: float = PITCH_WIDTH) -> DataFrame:
    """Tactical profile and composed labels of every cluster. ``ball``: the clusters' frame rows with
    ball_x_norm / ball_y_norm; ``seqs``: gain_x_m, duration_s, amplitude_m, shot, cross, loss."""
    group = [*keys, cluster]
    place = percentile_table(ball, group, ["ball_x_norm", "ball_y_norm"], [0.5])
    typical = percentile_table(seqs, group, ["gain_x_m", "duration_s", "amplitude_m"], [0.5])
    shares = seqs.groupBy(*group).agg(
        F.count("*").alias("n_sequences"), F.avg(flag("shot")).alias("shot_share"), F.avg(flag("cross")).alias("cross_share"),
        F.avg(flag("loss")).alias("loss_share"))
    df = shares.join(typical, group, "left").join(place, group, "left").withColumnsRenamed({
        "ball_x_norm_p500": "x_typical", "ball_y_norm_p500": "y_typical", "gain_x_m_p500": "gain_median",
        "duration_s_p500": "duration_median", "amplitude_m_p500": "amplitude_median"})
    move = (F.when(F.col("gain_median") > 10, "progresion_vertical").when(F.col("gain_median") < -8, "retroceso")
            .otherwise("circulacion"))
    shape = (F.when(F.col("amplitude_median") > width * 0.45, "cambio_orientacion")
             .when(F.col("duration_median") > 13, "posesion_larga").otherwise("ataque_corto"))
    danger = (F.when(F.col("shot_share") >= 0.20, "alta_amenaza").when(F.col("cross_share") >= 0.10, "amenaza_centro")
              .when(F.col("loss_share") >= 0.65, "baja_amenaza").otherwise("amenaza_media"))
    df = df.withColumns({"zone": zone_x4("x_typical", length), "lane": lane_y5("y_typical", width), "movement": move,
                         "structure": shape, "danger": danger})
    return df.withColumns({
        "tactical_label": F.concat_ws("_", "zone", "lane", "movement", "danger"),
        "detailed_label": F.concat_ws("_", "zone", "lane", "movement", "structure", "danger")})


def pattern_table(seqs: DataFrame, keys=MATCH, cluster: str = "cluster") -> DataFrame:
    """Per cluster: counts, mean indices, shots, modal cause and categories, and the risk level."""
    group = [*keys, cluster]
    out = seqs.groupBy(*group).agg(
        F.count("*").alias("n_sequences"), F.avg("idd").alias("idd_mean"), F.avg("ipo").alias("ipo_mean"),
        _sum("shot", "shots"), _sum("on_target", "shots_on_target"),
        # the domains of these labels are fixed and tiny, so the mode's counts are too
        F.mode("cause", True).alias("main_cause"), F.mode("idd_category", True).alias("idd_category_mode"),
        F.mode("ipo_category", True).alias("ipo_category_mode"))
    out = out.withColumn("risk", risk_bin((F.col("idd_mean") + F.col("ipo_mean")) / 2))
    return out.withColumn("risk_rank", rank_of("risk", RISK_LEVELS))


def pattern_order() -> list[Column]:
    """Published order: risk, then IPO, both descending; the cluster settles ties."""
    return [F.col("risk_rank").desc_nulls_last(), F.col("ipo_mean").desc(), F.col("cluster").asc()]


def cluster_summary(seqs: DataFrame, keys=MATCH, cluster: str = "cluster", labels: DataFrame | None = None) -> DataFrame:
    group = [*keys, cluster]
    out = seqs.groupBy(*group).agg(
        F.count("*").alias("sequences"), _sum("shot", "shots"), _sum("on_target", "shots_on_target"),
        F.round(F.avg("duration_s"), 1).alias("duration_mean"), F.avg(flag("shot")).alias("__p"))
    total = F.sum("sequences").over(Window.partitionBy(*keys))
    out = out.withColumns({"share_pct": F.round(F.col("sequences") / total * 100, 1),
                           "shot_pct": F.round(F.col("__p") * 100, 1)}).drop("__p")
    if labels is not None:
        out = out.join(labels.select(*group, "zone", "lane", "tactical_label"), group, "left")
    return out


def risk_summary(seqs: DataFrame, keys=MATCH, cluster: str = "cluster") -> DataFrame:
    return seqs.groupBy(*keys, cluster).agg(
        F.count("*").alias("sequences"), F.round(F.avg("idd"), 3).alias("idd_mean"),
        F.round(F.avg("ipo"), 3).alias("ipo_mean"), _sum("shot", "shots"), _sum("on_target", "shots_on_target"))


def category_matrix(seqs: DataFrame, keys=MATCH, names=CATEGORIES) -> DataFrame:
    """5 x 5 cross-tab of the two categories, every cell present."""
    cells = seqs.groupBy(*keys, "idd_category").agg(*[F.count_if(F.col("ipo_category") == n).alias(n) for n in names])
    frame = cells.select(*keys).distinct().withColumn("idd_category", F.explode(F.array(*[F.lit(n) for n in names])))
    return frame.join(cells, [*keys, "idd_category"], "left").fillna(0, list(names))


def extreme(seqs: DataFrame, kind: str) -> DataFrame:
    """``damage``: danger without disorder; ``chaos``: disorder without danger."""
    low, high = ("idd_category", "ipo_category") if kind == "damage" else ("ipo_category", "idd_category")
    return seqs.where((F.col(low) == "baja") & F.col(high).isin(*HIGH))


def damage_causes(seqs: DataFrame, keys=MATCH) -> DataFrame:
    hits = extreme(seqs, "damage").groupBy(*keys, "cause").agg(F.count("*").alias("frequency"))
    total = F.sum("frequency").over(Window.partitionBy(*keys))
    return hits.where("cause IS NOT NULL").withColumn("share_pct", F.round(F.col("frequency") / total * 100, 1))


def damage_zones(seqs: DataFrame, keys=MATCH, cluster: str = "cluster", width: float = PITCH_WIDTH) -> DataFrame:
    zone = lane_y5("y_end", width, list(LANE_CODES), "desconocida")
    return extreme(seqs, "damage").groupBy(*keys, zone.alias("zone"), cluster).agg(F.count("*").alias("n"))


def match_kpis(seqs: DataFrame, totals: DataFrame, patterns: DataFrame, keys=MATCH, cluster: str = "cluster",
               width: float = PITCH_WIDTH) -> DataFrame:
    """Ten (kpi, value) rows per match. ``totals``: shots_rival, shots_assigned, shots_on_target_rival."""
    k = list(keys)
    means = seqs.groupBy(*k).agg(F.count("*").alias("n"), F.avg("idd").alias("idd"), F.avg("ipo").alias("ipo"))
    common = mode_table(seqs, k, cluster, "common")
    cause = mode_table(seqs, k, "cause", "cause")
    zones = damage_zones(seqs, keys, cluster, width).groupBy(*k).agg(
        F.min_by(F.struct("zone", cluster), F.struct(-F.col("n"), "zone", cluster)).alias("z"))
    top = first_rows(patterns.withColumnRenamed(cluster, "cluster"), k, pattern_order()).select(
        *k, F.col("cluster").alias("top_cluster"))
    df = means.join(common, k, "left").join(cause, k, "left").join(zones, k, "left").join(top, k, "left").join(
        totals, k, "left")

    def text(c):
        return F.coalesce(c.cast("string"), F.lit("-"))

    def cname(c):
        return F.concat(F.lit("C"), c.cast("string"))

    rows = [("Secuencias rivales", text(F.col("n"))), ("Tiros Bepro rival", text(F.col("shots_rival"))),
            ("Tiros en secuencias", text(F.col("shots_assigned"))),
            ("Tiros a puerta rival", text(F.col("shots_on_target_rival"))),
            ("IDD medio", text(F.round("idd", 6))), ("IPO medio", text(F.round("ipo", 6))),
            ("Cluster mas repetido", text(cname(F.col("common")))), ("Zona/carril mas danino", text(F.col("z.zone"))),
            ("Foco defensivo", text(F.col("cause"))),
            ("Cluster prioritario", F.coalesce(cname(F.col(f"z.{cluster}")), F.col("top_cluster").cast("string"), F.lit("-")))]
    return df.select(*k, F.explode(F.array(*[F.struct(F.lit(n).alias("kpi"), v.alias("value")) for n, v in rows]))
                     .alias("r")).select(*k, "r.*")


# ------------------------------------------------------------------------------ validation

def possession_validation(tagged: DataFrame, teams: DataFrame, keys=("match_id", "seq_id")) -> DataFrame:
    """Per sequence: who has the ball in its frames, and whether that confirms the rival."""
    rows = tagged.where((F.col("possessor") == 1) & F.col("seq_id").isNotNull()).join(teams, "match_id")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("frames_held"), F.count_if(F.col("team_id") == F.col("rival_team")).alias("frames_rival"),
        F.count_if(F.col("team_id") == F.col("own_team")).alias("frames_own"))
    return out.withColumns({
        "rival_share": ratio("frames_rival", "frames_held"),
        "rival_ok": (F.col("frames_rival") > 0) & (F.col("frames_rival") >= F.col("frames_own"))})


VALIDATION_ALERT = "Revisar: el poseedor detectado no confirma dominio rival en la secuencia."


# ---------------------------------------------------------------------------- typologies

def typology_summary(seqs: DataFrame, keys=MATCH, typology: str = "typology", goals: bool = False) -> DataFrame:
    """Counts and means per typology; ``goals`` gives the report variant."""
    aggs = [F.count("*").alias("sequences"), F.avg("idd").alias("idd_mean"), F.max("idd").alias("idd_max"),
            F.avg("ipo").alias("ipo_mean"), F.max("ipo").alias("ipo_max"), F.max("xt_max").alias("xt_max"),
            F.avg("control_rival_mean").alias("control_rival_mean"), F.avg("danger_rival_mean").alias("danger_rival_mean"),
            _sum("shot", "shots"), _sum("on_target", "shots_on_target")]
    if goals:
        return seqs.groupBy(*keys, typology).agg(*aggs, _sum("goal", "goals"))
    out = seqs.groupBy(*keys, typology).agg(
        *aggs, F.count_if(F.col("ipo_category").isin(*HIGH)).alias("high_danger"),
        F.count_if(F.col("idd_category").isin(*HIGH)).alias("high_disorder"))
    means = [c for c in ("idd_mean", "idd_max", "ipo_mean", "ipo_max", "xt_max", "control_rival_mean", "danger_rival_mean")]
    return out.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 3) for c in means})


def lane_summary(seqs: DataFrame, keys=MATCH, y: str = "y_end", width: float = PITCH_WIDTH) -> DataFrame:
    """Sequences per lane, the five lanes in order, empty ones with 0."""
    counts = seqs.where(num(y).isNotNull()).groupBy(*keys, lane_y5(num(y), width, list(LANE_NAMES)).alias("lane")).agg(
        F.count("*").alias("sequences"))
    lanes = F.explode(F.array(*[F.struct(F.lit(i).alias("lane_order"), F.lit(n).alias("lane")) for i, n in enumerate(LANE_NAMES)]))
    frame = seqs.select(*keys).distinct().withColumn("l", lanes).select(*keys, "l.*")
    return frame.join(counts, [*keys, "lane"], "left").fillna(0, ["sequences"])


def most_damaged_lane(seqs: DataFrame, keys=MATCH, y: str = "y_end", weight: str = "score", width: float = PITCH_WIDTH) -> DataFrame:
    """Lane with the largest summed weight; when a match's weights sum to nothing, every row counts 1."""
    w = F.coalesce(num(weight), F.lit(0.0))
    sums = seqs.where(num(y).isNotNull()).groupBy(*keys, lane_y5(num(y), width, list(LANE_NAMES)).alias("lane")).agg(
        F.sum(w).alias("w"), F.count("*").cast("double").alias("n"))
    total = F.sum("w").over(Window.partitionBy(*keys))
    used = sums.withColumn("impact", F.when(total <= 0, F.col("n")).otherwise(F.col("w")))
    return used.groupBy(*keys).agg(F.min_by("lane", F.struct(-F.col("impact"), F.col("lane"))).alias("most_damaged_lane"))


def survival_by_cluster(seqs: DataFrame, keys=MATCH, cluster: str = "cluster", length: float = PITCH_LENGTH) -> DataFrame:
    """Share of sequences that reach the last third and the final zone."""
    x = num("x_max_norm")
    return seqs.where(x.isNotNull() & F.col(cluster).isNotNull()).groupBy(*keys, cluster).agg(
        (F.avg((x >= length * 2 / 3).cast("int")) * 100).alias("last_third_pct"),
        (F.avg((x >= length * 0.90).cast("int")) * 100).alias("final_zone_pct"))


def passes_by_typology(seqs: DataFrame, keys=MATCH, typology: str = "typology") -> DataFrame:
    return seqs.where(num("n_passes").isNotNull()).groupBy(*keys, typology).agg(
        F.avg(num("n_passes")).alias("passes_mean"), F.count("*").alias("sequences"))


def dominant_value(df: DataFrame, keys, column: str, name: str) -> DataFrame:
    """Mode of a text column, blanks and dashes left out."""
    return mode_table(df.where(~F.lower(column).isin("", "nan", "-")), list(keys), column, name)


def top_pattern(seqs: DataFrame, metric: str, keys=MATCH, typology: str = "typology", min_rows: int = 2,
                name: str = "top_typology") -> DataFrame:
    """Typology with the best mean of a metric among those with enough sequences."""
    means = seqs.groupBy(*keys, typology).agg(F.avg(metric).alias("v"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return means.groupBy(*keys).agg(F.min_by(F.struct(F.col(typology).alias("t"), "v"),
                                             F.struct(-F.col("v"), F.col(typology))).alias("b")).select(
        *keys, F.col("b.t").alias(name), F.col("b.v").alias(f"{name}_mean"))


def diff_vs_mean(seqs: DataFrame, metrics=("idd", "ipo"), keys=MATCH, typology: str = "typology") -> DataFrame:
    """Group mean against the match mean, in percent."""
    groups = seqs.groupBy(*keys, typology).agg(*[F.avg(m).alias(m) for m in metrics])
    whole = seqs.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}_all") for m in metrics])
    out = groups.join(whole, list(keys))
    return out.select(*keys, typology, *[
        ((F.try_divide(F.col(m), F.col(f"{m}_all")) - 1) * 100).alias(f"{m}_diff_pct") for m in metrics])


def sequence_vs_typology(seqs: DataFrame, metrics=("idd", "ipo", "xt_max"), keys=MATCH, typology: str = "typology") -> DataFrame:
    """Each sequence against its typology's mean, in percent."""
    out = group_stats(seqs, [*keys, typology], *[F.avg(m).alias(f"__{m}") for m in metrics])
    diff = {f"{m}_vs_pct": (F.try_divide(F.col(m), F.col(f"__{m}")) - 1) * 100 for m in metrics}
    return out.withColumns(diff).drop(*[f"__{m}" for m in metrics])


def interval_summary(seqs: DataFrame, keys=MATCH, minute: str = "minute", metrics=("idd", "ipo"), right_closed: bool = True,
                     flags=("shot", "on_target", "goal"), baseline: DataFrame | None = None) -> DataFrame:
    """Counts, means and finish flags per minute bin, every bin present; with the means of a baseline
    population (all typologies) beside them when given."""
    def per_bin(df):
        return df.withColumn("interval", minute_bin(minute, right_closed)).where("interval IS NOT NULL")

    out = per_bin(seqs).groupBy(*keys, "interval").agg(
        F.count("*").alias("sequences"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[_sum(f, f"{f}s") for f in flags])
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("interval_order"), F.lit(n).alias("interval"))
                               for i, n in enumerate(MINUTE_LABELS)]))
    frame = seqs.select(*keys).distinct().withColumn("b", bins).select(*keys, "b.*")
    out = frame.join(out, [*keys, "interval"], "left").fillna(0, ["sequences", *[f"{f}s" for f in flags]])
    if baseline is not None:
        base = per_bin(baseline).groupBy(*keys, "interval").agg(*[F.avg(m).alias(f"{m}_baseline") for m in metrics])
        out = out.join(base, [*keys, "interval"], "left")
    return out


def most_attacked_interval(intervals: DataFrame, keys=MATCH) -> DataFrame:
    return intervals.groupBy(*keys).agg(F.min_by(F.struct("interval", "sequences"), F.struct(
        -F.col("sequences"), "interval_order")).alias("b")).select(
        *keys, F.col("b.interval").alias("most_attacked"), F.col("b.sequences").alias("most_attacked_n"))


def summary_metrics(seqs: DataFrame, keys=MATCH, typology: str = "typology", windows: DataFrame | None = None,
                    length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Match KPIs of the overview page, one row per match. ``windows``: chronology windows with stress."""
    k = list(keys)
    x = num("x_max_norm")
    base = seqs.groupBy(*k).agg(
        F.count("*").alias("sequences"), _sum("shot", "shots"), _sum("on_target", "shots_on_target"), _sum("goal", "goals"),
        F.avg("duration_s").alias("duration_mean"), F.avg("n_passes").alias("passes_mean"), F.avg("idd").alias("idd_mean"),
        F.avg("ipo").alias("ipo_mean"), F.max("idd").alias("idd_max"), F.max("ipo").alias("ipo_max"),
        F.max("xt_max").alias("xt_max"), F.avg("control_rival_mean").alias("control_rival_mean"),
        F.avg("danger_rival_mean").alias("danger_rival_mean"), F.count_if(x >= length * 2 / 3).alias("last_third_entries"))
    out = base.join(mode_table(seqs, k, typology, "most_frequent"), k, "left")
    out = out.join(top_pattern(seqs, "ipo", keys, typology, name="most_dangerous").drop("most_dangerous_mean"), k, "left")
    out = out.join(most_damaged_lane(seqs, keys, width=width), k, "left")
    out = out.join(dominant_value(seqs, keys, "cause", "main_cause"), k, "left")
    out = out.join(most_attacked_interval(interval_summary(seqs, keys, metrics=(), flags=()), keys), k, "left")
    if windows is not None:
        worst = windows.where("sequences > 0").groupBy(*k).agg(F.min_by("interval", F.struct(
            -F.col("stress"), "interval_order")).alias("most_critical"))
        out = out.join(worst, k, "left")
    return out


# ------------------------------------------------------------------------ rankings and displays

def ranking(seqs: DataFrame, n: int = 15, keys=MATCH, by=("ipo", "idd"), seq_id: str = "seq_id") -> DataFrame:
    return first_rows(seqs, list(keys), [*[F.col(c).desc_nulls_last() for c in by], F.col(seq_id).asc()], n)


def extremes_top(seqs: DataFrame, kind: str, n: int = 8, keys=MATCH, seq_id: str = "seq_id") -> DataFrame:
    return first_rows(extreme(seqs, kind), list(keys), [F.col(seq_id).asc()], n)


def critical_sequences(seqs: DataFrame, n: int = 5, criterion: str = "score", keys=MATCH, typology: str | None = None,
                       seq_id: str = "seq_id") -> DataFrame:
    """Top sequences by score (``score``), ``ipo`` or ``idd``, of one typology or all."""
    rows = filter_typology(seqs, typology) if typology else seqs
    by = ("score", "ipo") if criterion == "score" else (criterion,)
    return ranking(rows, n, keys, by, seq_id)


def filter_typology(seqs: DataFrame, typology: str, everything: str = "Todas", column: str = "typology") -> DataFrame:
    return seqs if typology == everything else seqs.where(F.col(column) == typology)


def typology_options(seqs: DataFrame, keys=MATCH, column: str = "typology") -> DataFrame:
    """Distinct labels with their sort place: first number in the label (none: 999), then the text."""
    labels = seqs.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    number = F.coalesce(F.regexp_extract(column, r"(\d+)", 1).try_cast("int"), F.lit(999))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__n", column))
    return labels.withColumn("__n", number).withColumn("place", place).drop("__n")


def finish_text() -> Column:
    return F.concat_ws(" / ", *[flag(c).cast("string") for c in ("shot", "on_target", "goal")])


def display_table(seqs: DataFrame, order: list[Column], n: int = 12, keys=MATCH) -> DataFrame:
    """Top rows with readable index levels. Needs idd_level / ipo_level structs."""
    top = first_rows(seqs, list(keys), order, n)

    def reading(c):
        return F.concat(F.col(f"{c}_level.label"), F.lit(" ("), F.format_string("%.3f", F.col(c)), F.lit(")"))

    return top.select(*keys, "seq_id", "typology", "minute", "duration_s", reading("idd").alias("idd_text"),
                      reading("ipo").alias("ipo_text"), "xt_max", finish_text().alias("finish"), "cause")


def cluster_sheet(summary: DataFrame, keys=MATCH) -> DataFrame:
    return summary.select(*keys, typology_label("cluster").alias("typology"), "sequences", "share_pct", "duration_mean",
                          "shots", "shot_pct", "zone", "lane")


def pick_typology(summary: DataFrame, keys=MATCH, typology: str = "typology") -> DataFrame:
    """The typology with the largest (mean IPO, mean IDD, count) per match."""
    order = F.struct(F.coalesce("ipo_mean", F.lit(0.0)), F.coalesce("idd_mean", F.lit(0.0)), F.col("sequences"), F.col(typology))
    return summary.groupBy(*keys).agg(F.max_by(typology, order).alias(typology))


def critical_typology_context(seqs: DataFrame, picked: DataFrame, labels: DataFrame, keys=MATCH,
                              typology: str = "typology") -> DataFrame:
    """Rows of the picked typology summed up: count, modal cause, dominant zone and lane."""
    group = [*keys, typology]
    mine = seqs.join(picked, group, "left_semi")
    counts = mine.groupBy(*group).agg(F.count("*").alias("sequences"))
    out = counts.join(mode_table(mine, group, "cause", "main_cause"), group, "left").join(
        labels.select(*group, "zone", "lane"), group, "left")
    return out.withColumns({"zone": zone_label("zone"), "lane": lane_label("lane")})


def pattern_name(seqs: DataFrame, labels: DataFrame, keys=MATCH, cluster: str = "cluster") -> DataFrame:
    """Readable name per cluster from its modal sequence type, zone and lane; equal names in a match get
    the zone and lane in full, or the sector number."""
    group = [*keys, cluster]
    kinds = mode_table(seqs, group, "sequence_type", "kind")
    df = labels.select(*group, "zone", "lane").join(kinds, group, "left")
    m = F.create_map(*[F.lit(v) for kv in PATTERN_BASE.items() for v in kv])
    base = F.coalesce(F.try_element_at(m, F.col("kind")), F.lit("Ataque rival"))
    zone, lane, full = zone_short_label("zone"), lane_label("lane"), zone_label("zone")
    known_z, known_l = F.when(zone != NO_ZONE, zone), F.when(lane != NO_ZONE, lane)
    df = df.withColumn("name", F.concat_ws(" - ", base, known_z, known_l))
    df = df.withColumn("suffix", F.when((full != NO_ZONE) & (lane != NO_ZONE), F.concat(full, F.lit(" ("), lane, F.lit(")")))
                       .when(full != NO_ZONE, full).when(lane != NO_ZONE, lane).otherwise(F.lit(NO_ZONE)))
    many = F.count("*").over(Window.partitionBy(*keys, "name")) > 1
    own = (F.col("suffix") != NO_ZONE) & ~F.contains("name", "suffix")
    sector = F.concat(F.lit("Sector "), (F.col(cluster).try_cast("int") + 1).cast("string"))
    return df.withColumn("pattern", F.when(~many, F.col("name")).otherwise(
        F.concat_ws(" - ", "name", F.when(own, F.col("suffix")).otherwise(sector)))).select(*group, "pattern", "zone", "lane")


# ------------------------------------------------------------------------------ heat map, counts

def heatmap_bins(points: DataFrame, keys=MATCH, bins=(24, 16), x: str = "ball_x_norm", y: str = "ball_y_norm",
                 length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """2-D histogram; the last bin of each axis is closed on the right, points off the pitch are left out."""
    def cell(c, size, n):
        return F.least(F.floor(F.col(c) / F.lit(size) * n), F.lit(n - 1)).cast("int")

    inside = points.where(F.col(x).between(0, length) & F.col(y).between(0, width))
    return inside.groupBy(*keys, cell(x, length, bins[0]).alias("bin_x"), cell(y, width, bins[1]).alias("bin_y")).agg(
        F.count("*").alias("n"))


def smooth_heatmap(hist: DataFrame, keys=MATCH, bins=(58, 38), sigma: float = 1.35) -> DataFrame:
    """Gaussian smoothing of a histogram: each cell spreads to its neighbours with kernel weights, mass
    reflected at the edges; then cells are summed. The kernel is a small constant."""
    import numpy as np
    radius = int(4.0 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w = w / w.sum()
    taps = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(float(v)).alias("w"))
                               for i, v in zip(range(-radius, radius + 1), w)]))

    def fold(c, n):
        p = F.pmod(F.col(c) + F.col("t.o"), F.lit(2 * n))
        return F.when(p >= n, 2 * n - 1 - p).otherwise(p)

    out = hist.withColumn("v", F.col("n").cast("double"))
    for axis, n in (("bin_x", bins[0]), ("bin_y", bins[1])):
        spread = out.withColumn("t", taps).withColumn(axis, fold(axis, n).cast("int")).withColumn("v", F.col("v") * F.col("t.w"))
        out = spread.groupBy(*keys, "bin_x", "bin_y").agg(F.sum("v").alias("v"))
    return out


def cluster_counts(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.count("*").alias("sequences"))


def match_summary(tables: dict[str, DataFrame], keys=MATCH) -> DataFrame:
    """Row count of every stage per match, one wide row; stages without rows count 0."""
    parts = [df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, df in tables.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("stage") == name, F.col("n"))), F.lit(0)).alias(name)
                                     for name in tables])
