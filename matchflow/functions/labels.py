"""Label tables and level texts of the published outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col, num

# Ordered category names, lowest first.
CATEGORIES = ("baja", "media", "alta", "muy_alta", "critica")
CATEGORY_CUTS = (0.50, 0.75, 0.90, 0.97)
RISK_LEVELS = ("bajo", "medio", "alto")

# Minute bins (edges in minutes) and their names.
MINUTE_EDGES = (0, 15, 30, 45, 60, 75, 90, 120)
MINUTE_LABELS = ("0-15", "16-30", "31-45", "46-60", "61-75", "76-90", "90+")

# Code -> text tables.
LANE_TEXT = {
    "carril_1": "Banda izquierda",
    "carril_2": "Half-space izquierdo",
    "carril_3": "Carril central",
    "carril_4": "Half-space derecho",
    "carril_5": "Banda derecha",
    "carril_central": "Carril central",
    "banda_izquierda": "Banda izquierda",
    "banda_derecha": "Banda derecha",
}
ZONE_TEXT = {
    "zona_1": "Zona 1 - Inicio de campo propio",
    "zona_2": "Zona 2 - Zona media",
    "zona_3": "Zona 3 - Ultimo tercio",
    "zona_4": "Zona 4 - Zona de remate",
    "izquierda": "Banda izquierda",
    "derecha": "Banda derecha",
    "centro": "Carril central",
}
ZONE_SHORT_TEXT = {"zona_1": "Zona 1", "zona_2": "Zona 2", "zona_3": "Zona 3", "zona_4": "Zona 4"}
CAUSE_TEXT = {
    "estructura_retroceso": "problemas de repliegue",
    "estructura_anchura": "bloque demasiado abierto",
    "pitch_control_rival": "dominio rival en zonas peligrosas",
    "presion_distancia": "poca presión sobre poseedor",
    "sin etiqueta": "sin causa dominante",
}
TYPE_TEXT = {
    "ataque_elaborado": "Ataque posicional",
    "juego_directo": "Juego directo vertical",
    "transicion_rapida": "Transición tras robo",
    "balon_parado_con_continuidad": "Balón parado con continuidad",
    "descartada": "Secuencia descartada",
}
PATTERN_BASE = {
    "transicion_rapida": "Transicion tras robo",
    "juego_directo": "Juego directo vertical",
    "balon_parado_con_continuidad": "Balon parado con continuidad",
    "ataque_elaborado": "Ataque elaborado",
}
NO_ZONE = "Zona no identificada"

# Four reading levels per index, lowest first.
INDEX_LEVELS = {
    "idd": (
        ("Estable", "La estructura mantiene orden relativo."),
        ("Vulnerable", "Aparecen desajustes, todavia sin ruptura clara."),
        ("Inestable", "Hay perdida relevante de control defensivo."),
        ("Crítica", "La estructura queda muy expuesta."),
    ),
    "ipo": (
        ("Baja", "La secuencia genera poco peligro potencial."),
        ("Moderada", "El rival progresa, pero sin alcanzar peligro alto."),
        ("Alta", "La accion alcanza condiciones ofensivas relevantes."),
        ("Crítica", "La secuencia combina ventaja ofensiva y alto peligro."),
    ),
}
IPO_CUTS = (0.15, 0.35, 0.60)
XT_CUTS = (0.05, 0.10, 0.20)
XT_LEVELS = (
    ("Baja", "Zonas de bajo valor esperado."),
    ("Moderada", "Progresion con amenaza reconocible."),
    ("Alta", "Entrada en zonas de peligro relevante."),
    ("Muy peligrosa", "Cercania al area y alto potencial de ocasion."),
)


def lookup(code, table: dict, missing: str) -> Column:
    """Text of a code; unknown codes are spelt out, empty ones give ``missing``."""
    c = F.lower(col(code))
    m = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    spelt = F.replace(c, F.lit("_"), F.lit(" "))
    spelt = F.concat(F.upper(F.substring(spelt, 1, 1)), F.substring(spelt, 2, 2**31 - 1))
    unknown = F.when(c.isNull() | c.isin("", "nan"), F.lit(missing)).otherwise(spelt)
    return F.coalesce(F.try_element_at(m, c), unknown)


def lane_label(c) -> Column:
    return lookup(c, LANE_TEXT, NO_ZONE)


def zone_label(c) -> Column:
    return lookup(c, ZONE_TEXT, NO_ZONE)


def zone_short_label(c) -> Column:
    return lookup(c, {**ZONE_TEXT, **ZONE_SHORT_TEXT}, NO_ZONE)


def cause_label(c) -> Column:
    code = F.lower(col(c))
    m = F.create_map(*[F.lit(v) for pair in CAUSE_TEXT.items() for v in pair])
    return F.coalesce(F.try_element_at(m, code),
                      F.when(code.isNull() | code.isin("", "nan"), F.lit("-"))
                      .otherwise(F.replace(code, F.lit("_"), F.lit(" "))))


def sequence_type_label(c) -> Column:
    return lookup(c, TYPE_TEXT, "-")


def typology_label(cluster) -> Column:
    """Cluster n, also written 'Tn', shown as 'Tipología n+1'; other text stays, nothing is '-'."""
    text = F.trim(col(cluster).cast("string"))
    n = num(F.regexp_replace(text, r"^[Tt](?=\d+$)", ""))
    return (F.when(text.isNull() | (F.lower(text).isin("", "nan")), F.lit("-"))
            .when(n.isNull(), text).otherwise(F.concat(F.lit("Tipología "), (n.cast("int") + 1).cast("string"))))


def level_of(value, cuts) -> Column:
    """0 for NULL, else 1 + number of cuts at or below the value. Cuts are numbers or columns."""
    v = num(value)
    cs = [c if isinstance(c, Column) else F.lit(float(c)) for c in cuts]
    out = F.when(v.isNull(), F.lit(0))
    for i, c in enumerate(cs):
        out = out.when(v < c, F.lit(i + 1))
    return out.otherwise(F.lit(len(cs) + 1))


def classify_index(value, cuts, levels) -> Column:
    """Level number, label and description of an index value against its three cuts."""
    level = level_of(value, cuts)
    names = F.array(F.lit("-"), *[F.lit(label) for label, _ in levels])
    texts = F.array(F.lit("Sin dato disponible."), *[F.lit(text) for _, text in levels])
    return F.struct(level.alias("level"), F.element_at(names, level + 1).alias("label"),
                    F.element_at(texts, level + 1).alias("description"))


def threat_level(xt) -> Column:
    return classify_index(xt, XT_CUTS, XT_LEVELS)["label"]


def risk_level(value) -> Column:
    """Reading of one value: from .66 alto, from .33 medio, else bajo."""
    v = num(value)
    return (F.when(v.isNull(), F.lit("-")).when(v >= 0.66, F.lit("alto")).when(v >= 0.33, F.lit("medio"))
            .otherwise(F.lit("bajo")))


def risk_bin(value) -> Column:
    """Right-closed risk bins (-.01, .33], (.33, .66], (.66, 1]."""
    v = num(value)
    return (F.when((v > -0.01) & (v <= 0.33), F.lit("bajo")).when((v > 0.33) & (v <= 0.66), F.lit("medio"))
            .when((v > 0.66) & (v <= 1.0), F.lit("alto")))


def rank_of(c, names) -> Column:
    """Position of an ordered label, for sorting; NULL when unknown."""
    pos = F.array_position(F.array(*[F.lit(n) for n in names]), col(c))
    return F.when(pos > 0, pos)


def quadrant(idd, ipo, cut: float = 0.66) -> Column:
    """Reading of one sequence from both indices."""
    d, o = num(idd) >= cut, num(ipo) >= cut
    return (F.when(d & o, F.lit("prioridad defensiva alta")).when(o, F.lit("peligro eficiente"))
            .when(d, F.lit("ruptura sin castigo")).otherwise(F.lit("secuencia controlada")))


def minute_bin(minute, right_closed: bool, edges=MINUTE_EDGES, labels=MINUTE_LABELS) -> Column:
    """Bin name of a minute. Right-closed bins include the lowest edge; left-closed bins leave every
    upper edge open, so a minute on the last edge falls outside."""
    v = num(minute)
    out = None
    for i, label in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if right_closed:
            inside = ((v >= lo) if i == 0 else (v > lo)) & (v <= hi)
        else:
            inside = (v >= lo) & (v < hi)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out
