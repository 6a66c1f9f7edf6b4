"""Planar coordinates to longitude and latitude.

Inverse transverse Mercator on the GRS80 ellipsoid with the third-order
Krueger series (published formulas), as plain column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS80 ellipsoid and UTM constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)


def utm_to_lon_lat(x: Column, y: Column, zone: int = 30) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees for the northern hemisphere."""
    xi = y / (SCALE * _A)
    eta = (x - FALSE_EASTING) / (SCALE * _A)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.lit(math.radians(6 * zone - 183)) + F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lon), F.degrees(lat)


def with_lon_lat(df: DataFrame, x: str = "x", y: str = "y", zone: int = 30) -> DataFrame:
    """Add ``lon`` and ``lat``; null where the point is not valid."""
    from panelflow.operators.clean import valid_point

    lon, lat = utm_to_lon_lat(F.col(x), F.col(y), zone)
    ok = valid_point(x, y)
    return df.withColumn("lon", F.when(ok, lon)).withColumn("lat", F.when(ok, lat))


def share_in_box(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float], minimum: float = 0.98) -> DataFrame:
    """Share of located rows inside the box and whether it reaches the minimum."""
    inside = F.col(lon).between(box[0], box[1]) & F.col(lat).between(box[2], box[3])
    out = df.where(F.col(lon).isNotNull()).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("share_inside"))
    return out.withColumn("ok", (F.col("share_inside") >= minimum).cast("int"))


def lon_lat_sql(x: str, y: str, zone: int = 30) -> tuple[str, str]:
    """Same series as SQL text, for the oracle."""
    xi, eta = f"(({y}) / {SCALE * _A!r}::DOUBLE)", f"((({x}) - {FALSE_EASTING!r}::DOUBLE) / {SCALE * _A!r}::DOUBLE)"
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 += f" - {b!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
        eta1 += f" - {b!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = chi + "".join(f" + {d!r}::DOUBLE * sin({2 * j} * {chi})" for j, d in enumerate(DELTA, start=1))
    lon = f"{math.radians(6 * zone - 183)!r}::DOUBLE + atan2(sinh({eta1}), cos({xi1}))"
    return f"degrees({lon})", f"degrees({lat})"
