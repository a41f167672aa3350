"""Null-safe scalar helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """Text or number to DOUBLE; bad text, NaN and infinities become NULL."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def clip(c, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` alone would skip it)."""
    v = col(c)
    out = v
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(v.isNotNull(), out)


def ratio(a, b, default: float | None = 0.0) -> Column:
    """a / b; division by zero or NULL gives ``default``."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def flag(c) -> Column:
    """Condition to 0/1, NULL counting as 0."""
    return F.coalesce(col(c).cast("int"), F.lit(0))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def present(df: DataFrame, names) -> list[str]:
    """Those of ``names`` the frame has, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def mean_of(arr) -> Column:
    """Mean of an array column, NULL entries left out; NULL when nothing is left."""
    a = F.filter(col(arr), lambda v: v.isNotNull())
    total = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(a))


def hms(seconds) -> Column:
    """Seconds to HH:MM:SS; unreadable input gives 00:00:00."""
    s = F.coalesce(F.floor(num(seconds)), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60),
                           F.pmod(s, F.lit(60)))
