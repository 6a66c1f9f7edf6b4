"""Numeric parsing, clipping and small statistical formulas as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_975 = 1.959963984540054  # fixed value: 97.5 % normal quantile
RISK_EDGES = (0.04, 0.08)  # fixed values: LOW / MEDIUM / HIGH


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decimal_comma(col: Column | str) -> Column:
    """Text with decimal comma to double; unparsable text gives null."""
    return F.replace(F.trim(_c(col).cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def grouped_number(col: Column | str) -> Column:
    """``12.345,6`` -> 12345.6"""
    plain = F.replace(F.trim(_c(col)), F.lit("."), F.lit(""))
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


def clip(col: Column | str, low: Column, high: Column) -> Column:
    c = _c(col)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def right_closed_bin(col: Column | str, edges: Sequence[float]) -> Column:
    """Bin number k for edges[k-1] < v <= edges[k]; null outside."""
    v = _c(col)
    expr = F.when(v <= edges[0], None)
    for k, edge in enumerate(edges[1:], start=1):
        expr = expr.when(v <= edge, F.lit(k))
    return expr


def left_closed_bin(col: Column | str, edges: Sequence[float]) -> Column:
    """Bin number k for edges[k-1] <= v < edges[k]; null outside."""
    v = _c(col)
    expr = F.when(v < edges[0], None)
    for k, edge in enumerate(edges[1:], start=1):
        expr = expr.when(v < edge, F.lit(k))
    return expr


def risk_band(p: Column | str) -> Column:
    low, high = RISK_EDGES
    return F.when(_c(p) < low, "LOW").when(_c(p) < high, "MEDIUM").otherwise("HIGH")


def ratio_to_base(p: Column | str, base: Column | str) -> Column:
    return _c(p) / F.nullif(_c(base), F.lit(0.0))


def round_half_even(col: Column | str, places: int) -> Column:
    """Banker's rounding, as the exported tables use it; noise past 12 decimals does not break a tie."""
    return F.bround(F.round(_c(col).cast("double"), 12), places)


def request_turnover_rate(turnovers: Column | str, age: Column | str) -> Column:
    """Turnovers per year of age, never above one."""
    return F.least(_c(turnovers) / F.greatest(_c(age), F.lit(1.0)), F.lit(1.0))


def wilson(successes: Column | str, n: Column | str, z: float = NORMAL_975) -> Column:
    """Struct (rate, low, high); null without observations."""
    k, m = _c(successes).cast("double"), F.nullif(_c(n).cast("double"), F.lit(0.0))
    p = k / m
    z2 = z * z
    centre = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    return F.struct(
        p.alias("rate"),
        F.greatest(centre - half, F.lit(0.0)).alias("low"),
        F.least(centre + half, F.lit(1.0)).alias("high"),
    )
