"""Pitch geometry. Sizes are parameters; the defaults are the data provider's 102 m x 64 m."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

PITCH_LENGTH = 102.0
PITCH_WIDTH = 64.0

# Lane names, left to right, in the two label sets of the published tables.
LANE_CODES = ("banda_izquierda", "halfspace_izquierdo", "carril_central", "halfspace_derecho", "banda_derecha")
LANE_NAMES = ("Banda izquierda", "Half-space izquierdo", "Carril central", "Half-space derecho", "Banda derecha")


def to_metres(c, size: float) -> Column:
    return col(c) * F.lit(float(size))


def mirror(c, keep, size: float) -> Column:
    """Value as seen from the attacking side: kept where ``keep``, else ``size - value``."""
    return F.when(col(keep), col(c)).otherwise(F.lit(float(size)) - col(c))


def mirror_fixed(c, period, size: float) -> Column:
    """Period 0 keeps the value, every other period is mirrored."""
    return mirror(c, col(period) == 0, size)


def bands(c, cuts, labels, missing: str | None = None) -> Column:
    """First label whose upper cut lies above the value; the last label is open-ended."""
    v = col(c)
    out = F.when(v.isNull(), F.lit(missing))
    for cut, label in zip(cuts, labels):
        out = out.when(v < F.lit(float(cut)), F.lit(label))
    return out.otherwise(F.lit(labels[len(cuts)]))


def zone_x4(x, length: float = PITCH_LENGTH) -> Column:
    return bands(x, [length * q for q in (0.25, 0.50, 0.75)], [f"zona_{i}" for i in range(1, 5)], "zona_4")


def lane_y5(y, width: float = PITCH_WIDTH, labels=None, missing: str | None = "carril_5") -> Column:
    labels = labels or [f"carril_{i}" for i in range(1, 6)]
    return bands(y, [width * q for q in (0.20, 0.40, 0.60, 0.80)], labels, missing)


def grid_cell(c, size: float, n: int) -> Column:
    """Cell number of a coordinate on ``n`` equal cells, clamped to the pitch."""
    cell = F.floor(col(c) / F.lit(float(size)) * n)
    return F.when(cell.isNotNull(), F.least(F.greatest(cell, F.lit(0)), F.lit(n - 1))).cast("int")
