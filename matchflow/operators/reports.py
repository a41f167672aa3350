"""Deterministic report texts and the nested report record of each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag
from . import rollups as ru
from .ordered import first_rows

MATCH = ("match_id",)


def _int(c) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("string")


def _two(c) -> Column:
    return F.format_string("%.2f", F.col(c))


def match_report_text(totals: DataFrame, patterns: DataFrame, keys=MATCH) -> DataFrame:
    """Report sentences of each match, joined by line breaks. ``totals``: sequences, shots_rival,
    shots_on_target_rival, shots_assigned; the first row of the published pattern order is the top pattern."""
    k = list(keys)
    top = first_rows(patterns, k, ru.pattern_order()).select(*k, "cluster", "idd_mean", "ipo_mean", "main_cause")
    df = totals.join(top, k, "left")
    lines = [
        F.concat(F.lit("Partido "), F.col("match_id").cast("string"), F.lit(".")),
        F.concat(F.lit("Se han detectado "), _int("sequences"), F.lit(" secuencias ofensivas rivales.")),
        F.concat(F.lit("El rival registra "), _int("shots_rival"), F.lit(" tiros oficiales, "), _int("shots_on_target_rival"),
                 F.lit(" de ellos a puerta.")),
        F.when(F.coalesce("shots_assigned", F.lit(0)) != F.coalesce("shots_rival", F.lit(0)),
               F.concat(_int("shots_assigned"), F.lit(" tiros quedan asociados a secuencias analizadas; el resto quedan fuera "
                                                      "por criterios de continuidad."))),
        F.when(F.col("cluster").isNotNull(),
               F.concat(F.lit("El patron de mayor riesgo aparece en el cluster "), F.col("cluster").cast("string"),
                        F.lit(", con IDD medio "), _two("idd_mean"), F.lit(" e IPO medio "), _two("ipo_mean"), F.lit("."))),
        F.when(F.col("cluster").isNotNull(), F.concat(F.lit("La causa principal dominante es "),
                                                      F.coalesce("main_cause", F.lit("None")), F.lit("."))),
    ]
    return df.select(*k, F.concat_ws("\n", *lines).alias("report"))


def match_report_markdown(totals: DataFrame, kpis: DataFrame, risk: DataFrame, causes: DataFrame, zones: DataFrame, keys=MATCH) -> DataFrame:
    """The published markdown report of each match, from its totals and roll-up tables."""
    k = list(keys)
    mean = kpis.groupBy(*k).agg(
        F.max(F.when(F.col("kpi") == "IDD medio", F.col("value").try_cast("double"))).alias("idd"),
        F.max(F.when(F.col("kpi") == "IPO medio", F.col("value").try_cast("double"))).alias("ipo"))
    top = first_rows(risk, k, [F.col("ipo_mean").desc(), F.col("cluster")]).select(
        *k, "cluster", F.col("sequences").alias("top_n"), F.col("idd_mean").alias("top_idd"), F.col("ipo_mean").alias("top_ipo"))
    cause = first_rows(causes, k, [F.col("frequency").desc(), F.col("cause")]).select(*k, F.col("cause").alias("top_cause"))
    zone = first_rows(zones, k, [F.col("n").desc(), F.col("zone"), F.col("cluster")]).select(*k, F.col("zone").alias("top_zone"))
    df = totals
    for part in (mean, top, cause, zone):
        df = df.join(part, k, "left")
    none = F.lit("no identificada")

    def two(c):
        return F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))

    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    body = F.concat(
        F.lit("# Informe del partido "), F.col("match_id").cast("string"), F.lit("\n\nEl analisis detecta **"), _int("sequences"),
        F.lit(" secuencias ofensivas rivales**. El rival registra **"), _int("shots_rival"), F.lit(" tiros oficiales**, de los cuales **"),
        _int("shots_on_target_rival"), F.lit("** van a puerta. Dentro de las secuencias analizadas quedan asociados **"), _int("shots_assigned"),
        F.lit(" tiros**.\n\n## Lectura defensiva global\n\nEl **IDD medio** del partido es **"), two("idd"), F.lit("** y el **IPO medio** es **"),
        two("ipo"), F.lit("**. La causa defensiva dominante es **"), F.coalesce("top_cause", none),
        F.lit("** y la zona/carril que concentra mas dano eficiente es **"), F.coalesce("top_zone", none),
        F.lit("**.\n\n## Patron prioritario\n\nEl cluster de mayor prioridad analitica es el **cluster "), shown("cluster"), F.lit("**, con **"),
        shown("top_n"), F.lit(" secuencias**, IDD medio **"), two("top_idd"), F.lit("** e IPO medio **"), two("top_ipo"), F.lit("**.\n"))
    return df.select(*k, body.alias("report"))


def basic_summary_text() -> Column:
    """One-sentence summary from the counts of a match."""
    def grouped(c):
        return F.format_string("%,d", F.col(c).cast("long"))

    return F.concat(
        F.lit("Partido "), F.col("match_id").cast("string"), F.lit(": equipo propio "), F.col("own_team").cast("string"),
        F.lit(" vs rival "), F.col("rival_team").cast("string"), F.lit(". Tracking original: "), grouped("tracking_raw"),
        F.lit(" filas; tracking a 250 ms: "), grouped("tracking_bucketed"), F.lit(" filas. Eventing: "), grouped("events_raw"),
        F.lit(" eventos. Tiros rivales oficiales: "), _int("shots_rival"), F.lit(" ("), _int("shots_on_target_rival"),
        F.lit(" a puerta)."))


# Fields of the sequence records inside the report.
RECORD_FIELDS = ("seq_id", "minute", "typology", "sequence_type", "idd", "ipo", "score", "xt_max", "cause", "shot", "on_target", "goal",
                 "control_rival_mean", "danger_rival_mean")


def _records(rows: DataFrame, keys, order: list[Column], place: list[Column], fields, n: int | None, name: str) -> DataFrame:
    """At most ``n`` rows per match (small by construction) as one sorted array of structs."""
    picked = first_rows(rows, list(keys), order, n) if n else rows
    names = [c for c in fields if c in rows.columns]
    types = dict(rows.dtypes)
    body = F.struct(*[F.round(c, 3).alias(c) if types[c] in ("double", "float") else F.col(c) for c in names])
    packed = F.array_sort(F.collect_list(F.struct(F.struct(*place).alias("o"), body.alias("b"))))
    return picked.groupBy(*keys).agg(F.transform(packed, lambda r: r["b"]).alias(name))


def report_payload(seqs: DataFrame, windows: DataFrame | None = None, keys=MATCH) -> DataFrame:
    """One nested record per match: metrics, typologies, causes, intervals, top sequences, the critical
    window and the pointers of the summary. Every list is bounded (typologies, 8 causes, 7 intervals,
    8 critical and 5 + 5 top sequences), so the record stays small."""
    k = list(keys)
    metrics = seqs.groupBy(*k).agg(
        F.count("*").alias("sequences"), F.sum(flag("shot")).alias("shots"), F.sum(flag("on_target")).alias("shots_on_target"),
        F.sum(flag("goal")).alias("goals"), F.round(F.avg("idd"), 3).alias("idd_mean"), F.round(F.max("idd"), 3).alias("idd_max"),
        F.round(F.avg("ipo"), 3).alias("ipo_mean"), F.round(F.max("ipo"), 3).alias("ipo_max"),
        F.round(F.avg("control_rival_mean"), 3).alias("control_rival_mean"),
        F.round(F.avg("danger_rival_mean"), 3).alias("danger_rival_mean"), F.count_if(F.col("ipo") >= 0.60).alias("high_threat"))
    typ = ru.typology_summary(seqs, keys, goals=True)
    typ_list = _records(typ, k, [], [-F.col("ipo_mean"), -F.col("idd_mean"), F.col("typology")], [c for c in typ.columns if c not in k],
                        None, "typologies")
    causes = seqs.groupBy(*k, F.coalesce("cause", F.lit("Causa no identificada")).alias("cause")).agg(F.count("*").alias("sequences"))
    cause_list = _records(causes, k, [F.col("sequences").desc(), F.col("cause")], [-F.col("sequences"), F.col("cause")],
                          ("cause", "sequences"), 8, "causes")
    spans = ru.interval_summary(seqs, keys)
    span_list = _records(spans, k, [], [F.col("interval_order")], [c for c in spans.columns if c not in (*k, "interval_order")], None,
                         "intervals")
    tops = []
    for name, by, n in (("critical", "score", 8), ("top_idd", "idd", 5), ("top_ipo", "ipo", 5)):
        tops.append(_records(seqs, k, [F.col(by).desc_nulls_last(), F.col("seq_id")], [-F.col(by), F.col("seq_id")], RECORD_FIELDS, n, name))
    pointers = typ.groupBy(*k).agg(
        F.min_by("typology", F.struct(-F.col("sequences"), -F.col("ipo_mean"), F.col("typology"))).alias("most_frequent"),
        F.min_by("typology", F.struct(-F.col("ipo_mean"), -F.col("idd_mean"), F.col("typology"))).alias("most_dangerous"),
        F.min_by("typology", F.struct(-F.col("idd_mean"), -F.col("ipo_mean"), F.col("typology"))).alias("most_disorganising"))
    out = metrics
    for part in (ru.most_damaged_lane(seqs, keys), ru.most_attacked_interval(spans, keys), typ_list, cause_list, span_list, *tops, pointers):
        out = out.join(part, k, "left")
    if windows is not None:
        worst = windows.where("sequences > 0").groupBy(*k).agg(F.min_by(F.struct(
            "interval", F.round(F.col("stress") * 100, 1).alias("index"), "sequences", F.round("idd", 3).alias("idd"),
            F.round("ipo", 3).alias("ipo"), F.round("momentum", 3).alias("momentum"), "shots", "shots_on_target", "last_third_entries"),
            F.struct(-F.col("stress"), "interval_order")).alias("critical_window"))
        out = out.join(worst, k, "left")
    return out


def payload_text(payload: DataFrame) -> DataFrame:
    """Markdown report of each record: summary, typology table, causes, critical plays, intervals."""
    def table(rows, fields):
        def line(r):
            return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(r[f].cast("string"), F.lit("-")) for f in fields]), F.lit(" |"))
        return F.array_join(F.transform(rows, line), "\n")

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    plays = F.array_join(F.transform(F.slice("critical", 1, 5), lambda s: F.concat(
        F.lit("- Secuencia "), s["seq_id"].cast("string"), F.lit(" ("), F.coalesce(s["minute"].cast("string"), F.lit("-")), F.lit("'): "),
        F.coalesce(s["typology"], F.lit("-")), F.lit(". IDD "), F.coalesce(s["idd"].cast("string"), F.lit("-")), F.lit(", IPO "),
        F.coalesce(s["ipo"].cast("string"), F.lit("-")), F.lit("."))), "\n")
    body = F.concat_ws(
        "\n", F.concat(F.lit("# Informe táctico postpartido: "), F.col("match_id").cast("string")), F.lit(""), F.lit("## 1. Resumen general"),
        F.concat(F.lit("Secuencias: "), text("sequences"), F.lit(", tiros: "), text("shots"), F.lit(", a puerta: "), text("shots_on_target"),
                 F.lit(", goles: "), text("goals"), F.lit(". IDD "), text("idd_mean"), F.lit(", IPO "), text("ipo_mean"),
                 F.lit(". Alta amenaza: "), text("high_threat"), F.lit(". Zona más dañada: "), text("most_damaged_lane"),
                 F.lit(". Tramo más atacado: "), text("most_attacked"), F.lit(".")),
        F.lit("## 2. Tipologías de ataque rival"), F.concat(F.lit("Más repetida: "), text("most_frequent"), F.lit(". Más peligrosa: "),
                                                           text("most_dangerous"), F.lit(". Más desorganizante: "), text("most_disorganising"), F.lit(".")),
        table(F.col("typologies"), ("typology", "sequences", "idd_mean", "ipo_mean", "shots", "goals")),
        F.lit("## 3. Organización defensiva"), table(F.col("causes"), ("cause", "sequences")), F.lit("## 4. Jugadas críticas"), plays,
        F.lit("## 5. Análisis temporal"), table(F.col("intervals"), ("interval", "sequences", "idd_mean", "ipo_mean", "shots", "goals")))
    return payload.select("match_id", body.alias("report"))
