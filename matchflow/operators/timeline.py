"""Match clock, momentum and chronology windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, flag, num
from ..functions.geometry import LANE_NAMES, PITCH_LENGTH, PITCH_WIDTH, lane_y5
from ..functions.labels import MINUTE_EDGES, MINUTE_LABELS, minute_bin
from .ordered import decayed_sum
from .quantiles import mode_table, percentile_table

MATCH = ("match_id",)

# Momentum weights, decay and the two limits of the phases.
MOMENTUM_ALPHA = 0.80
IDD_WEIGHT, IPO_WEIGHT = 0.40, 0.60
ALERT_LIMIT, STRESS_LIMIT = 0.20, 0.32


def match_minute(df: DataFrame, keys=MATCH, end_s: str = "end_s", name: str = "minute", decimals: int | None = None) -> DataFrame:
    """End of the sequence in minutes; the second half is moved by 45 when its earliest is below 40."""
    minute = num(end_s) / 60
    second = F.min(F.when(F.col("period") == 1, minute)).alias("__m")
    out = df.join(df.groupBy(*keys).agg(second), list(keys), "left")
    moved = F.when((F.col("period") == 1) & (F.col("__m") < 40), minute + 45).otherwise(minute)
    return out.withColumn(name, F.round(moved, decimals) if decimals is not None else moved).drop("__m")


def momentum_signal() -> Column:
    return clip(F.lit(IDD_WEIGHT) * F.coalesce("idd", F.lit(0.0)) + F.lit(IPO_WEIGHT) * F.coalesce("ipo", F.lit(0.0)), 0, 1)


def end_minute(minute: str = "minute", duration: str = "duration_s") -> Column:
    return F.col(minute) + F.greatest(F.coalesce(num(duration), F.lit(6.0)), F.lit(2.0)) / 60


def minute_signal(df: DataFrame, minute: Column, signal: Column, keys=MATCH) -> DataFrame:
    """Noisy-OR of the signals of each minute: 1 - product(1 - s), combined on the map side."""
    s = clip(F.coalesce(signal, F.lit(0.0)), 0, 1)
    return df.groupBy(*keys, minute.alias("minute")).agg((F.lit(1.0) - F.product(F.lit(1.0) - s)).alias("signal"))


def decayed(signals: DataFrame, ends: DataFrame, keys=MATCH, alpha: float = MOMENTUM_ALPHA) -> DataFrame:
    """Dense minute axis 0..last with m = alpha * m + (1 - alpha) * s from 0. ``ends``: keys, last_minute."""
    k = list(keys)
    axis = ends.select(*k, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_minute").cast("long"))).alias("minute"))
    line = axis.join(signals, [*k, "minute"], "left").select(*k, "minute", F.coalesce("signal", F.lit(0.0)).alias("signal"))
    out = decayed_sum(line, k, "minute", F.lit(1 - alpha) * F.col("signal"), alpha, "momentum")
    return out.withColumn("momentum", clip("momentum", 0, 1))


def momentum_timeline(seqs: DataFrame, keys=MATCH, alpha: float = MOMENTUM_ALPHA) -> DataFrame:
    """Per minute of each match: noisy-OR danger signal and its decayed momentum."""
    rows = seqs.where(num("minute").isNotNull())
    ends = rows.groupBy(*keys).agg(F.greatest(F.lit(95), F.ceil(F.max(end_minute()) + 2)).cast("long").alias("last_minute"))
    signals = minute_signal(rows, F.greatest(F.floor("minute"), F.lit(0)).cast("long"), momentum_signal(), keys)
    return decayed(signals, ends, keys, alpha)


def chronology_base(seqs: DataFrame, keys=MATCH, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Sequence rows prepared for the chronology: clock, signal, last-third entry, lane."""
    rows = seqs.where(num("minute").isNotNull())
    q = percentile_table(rows.withColumn("__xt", F.coalesce("xt_max", F.lit(0.0))), list(keys), ["__xt"], [0.90])
    out = rows.join(q, list(keys), "left")
    scale = F.greatest(F.coalesce("__xt_p900", F.lit(0.22)), F.lit(0.12))
    return out.withColumns({
        "start_minute": F.col("minute"), "end_minute": end_minute(), "idd": F.coalesce("idd", F.lit(0.0)),
        "ipo": F.coalesce("ipo", F.lit(0.0)), "xt_norm": clip(F.coalesce("xt_max", F.lit(0.0)) / scale, 0, 1),
        "last_third": flag(num("x_max_norm") >= length * 2 / 3), "signal": momentum_signal(),
        "lane": lane_y5("y_end", width, list(LANE_NAMES), "Desconocido")}).drop("__xt_p900")


def chronology_windows(base: DataFrame, keys=MATCH) -> DataFrame:
    """Left-closed windows: counts, means, shots, goals, entries, momentum and stress, all windows present."""
    k = list(keys)
    tagged = base.withColumn("interval", minute_bin("minute", False)).where("interval IS NOT NULL")
    counts = tagged.groupBy(*k, "interval").agg(
        F.count("*").alias("sequences"), F.avg("idd").alias("idd"), F.avg("ipo").alias("ipo"), F.sum(flag("shot")).alias("shots"),
        F.sum(flag("on_target")).alias("shots_on_target"), F.sum(flag("goal")).alias("goals"),
        F.sum("last_third").alias("last_third_entries"))
    line = momentum_timeline(base, keys).withColumn("interval", minute_bin("minute", False)).where("interval IS NOT NULL")
    means = line.groupBy(*k, "interval").agg(F.avg("momentum").alias("momentum"), F.max("momentum").alias("momentum_max"),
                                             # at most 30 minutes per window
                                             F.percentile("momentum", F.lit(0.9)).alias("momentum_p90"))
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("interval_order"), F.lit(n).alias("interval"))
                               for i, n in enumerate(MINUTE_LABELS)]))
    frame = base.select(*k).distinct().withColumn("b", bins).select(*k, "b.*")
    out = frame.join(counts, [*k, "interval"], "left").join(means, [*k, "interval"], "left").fillna(
        0, ["sequences", "shots", "shots_on_target", "goals", "last_third_entries"])
    stress = F.lit(0.60) * F.coalesce("momentum_p90", F.lit(0.0)) + F.lit(0.40) * F.coalesce("momentum", F.lit(0.0))
    return out.withColumn("stress", clip(stress, 0, 1))


def phase_label(stress="stress", shots="shots", entries="last_third_entries") -> Column:
    return (F.when((F.col(stress) >= STRESS_LIMIT) | (F.col(shots) >= 2), "ESTRÉS ALTO")
            .when((F.col(stress) >= ALERT_LIMIT) | (F.col(entries) >= 2), "ALERTA").otherwise("CONTROLADO"))


def select_windows(windows: DataFrame, keys=MATCH) -> DataFrame:
    """Worst, second worst and calmest of the rest, and the window with most shots; windows with
    sequences only, earlier windows first on ties. At most seven rows per match."""
    k = list(keys)
    w = windows.where("sequences > 0")
    part = Window.partitionBy(*k)
    place = F.row_number().over(part.orderBy(F.col("stress").desc(), "interval_order"))
    n = F.count("*").over(part)
    calm = F.row_number().over(part.orderBy((F.col("__place") <= 2).cast("int"), F.col("stress").asc(), "interval_order"))
    shot = F.row_number().over(part.orderBy(F.col("shots").desc(), F.col("stress").desc(), "interval_order"))
    marked = w.withColumn("__place", place).withColumn("__n", n).withColumn("__calm", calm).withColumn("__shot", shot)
    kinds = F.array_compact(F.array(
        F.when(F.col("__place") == 1, "critical"), F.when(F.col("__place") == 2, "warning"),
        F.when((F.col("__calm") == 1) & (F.col("__n") > 2), "stable"), F.when(F.col("__shot") == 1, "most_shots")))
    return marked.withColumn("kind", F.explode(kinds)).withColumn("phase", phase_label()).drop(
        "__place", "__n", "__calm", "__shot")


def window_card(base: DataFrame, windows: DataFrame, keys=MATCH) -> DataFrame:
    """Sequences inside each selected window: counts, means, dominant typology and lane."""
    k = list(keys)
    picked = windows.select(*k, "interval", "kind", "stress")
    tagged = base.withColumn("interval", minute_bin("minute", False)).where("interval IS NOT NULL").drop("kind", "stress")
    rows = tagged.join(picked, [*k, "interval"])
    group = [*k, "kind", "interval", "stress"]
    out = rows.groupBy(*group).agg(
        F.count("*").alias("sequences"), F.sum(flag("shot")).alias("shots"), F.sum("last_third").alias("last_third_entries"),
        F.avg("idd").alias("idd_mean"), F.avg("ipo").alias("ipo_mean"))
    usable = rows.where(~F.lower("typology").isin("", "nan", "-"))
    out = out.join(mode_table(usable, [*k, "kind"], "typology", "typology"), [*k, "kind"], "left")
    return out.join(mode_table(rows, [*k, "kind"], "lane", "lane"), [*k, "kind"], "left")


def typology_timeline(seqs: DataFrame, keys=MATCH) -> DataFrame:
    """Bars of the typology chart: start, end, visible length and finish tag."""
    finish = (F.when(flag("goal") > 0, "goal").when(flag("on_target") > 0, "on_target").when(flag("shot") > 0, "shot")
              .otherwise("none"))
    end = end_minute()
    return seqs.where(num("minute").isNotNull()).select(
        *keys, "seq_id", "typology", F.col("minute").alias("start_minute"), end.alias("end_minute"),
        F.greatest(end - F.col("minute"), F.lit(0.05)).alias("bar_minutes"), finish.alias("finish"))


def video_time(df: DataFrame, index: DataFrame, match_s: str, name: str, match_key: str = "match_id") -> DataFrame:
    """Match second to video second. ``index``: match_id, period, padding_ms, start_ms; rows without an
    entry keep the match second."""
    out = df.join(index.select(match_key, "period", F.col("padding_ms").alias("__pad"), F.col("start_ms").alias("__start")),
                  [match_key, "period"], "left")
    shifted = (F.col(match_s) * 1000 - F.col("__start") + F.col("__pad")) / F.lit(1000.0)
    return out.withColumn(name, F.coalesce(F.greatest(shifted, F.when(shifted.isNotNull(), F.lit(0.0))),
                                           F.col(match_s).cast("double"))).drop("__pad", "__start")


def clip_bounds(df: DataFrame, index: DataFrame, start_s: str = "start_s", end_s: str = "end_s") -> DataFrame:
    """Match and video bounds of each sequence with two seconds of context; eight seconds when inverted."""
    start = F.coalesce(num(start_s), F.lit(0.0))
    end = F.coalesce(num(end_s), start + 8)
    end = F.when(end <= start, start + 8).otherwise(end)
    out = df.withColumns({"match_from": F.greatest(start - 2, F.lit(0.0)), "match_to": end + 2})
    out = video_time(video_time(out, index, "match_from", "video_from"), index, "match_to", "__to")
    fallback = F.col("video_from") + F.greatest(F.col("match_to") - F.col("match_from"), F.lit(8.0))
    return out.withColumn("video_to", F.when(F.col("__to") <= F.col("video_from"), fallback).otherwise(F.col("__to"))).drop("__to")


def video_index(wide: DataFrame) -> DataFrame:
    """Per-match video row to (match_id, period, padding_ms, start_ms) rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), num(f"period{p}_padding_ms").alias("padding_ms"),
                                        num(f"period{p}_start_ms").alias("start_ms")) for p in (0, 1)]))
    return wide.select("match_id", rows.alias("r")).select("match_id", "r.*").dropna()
