"""Convex-hull area of every group of points.

The hull of a union is the hull of the hulls, so it is computed like a
combinable aggregate: each partition keeps only the corners of its running
hull per group, salted groups merge those, and the last step sees a handful of
corners per group however many points the group has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGE_SALTS = 32


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners in counter-clockwise order (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq):
        out = []
        for px, py in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0:
                    break
                out.pop()
            out.append((px, py))
        return out[:-1]

    return chain(pts) + chain(reversed(pts))


def _area(corners: list[tuple[float, float]]) -> float:
    x0, y0 = corners[0]
    shifted = [(x - x0, y - y0) for x, y in corners]
    return abs(sum(a * d - b * c for (a, b), (c, d) in zip(shifted, shifted[1:] + shifted[:1]))) / 2


def hull_areas(df: DataFrame, group: str, x: str = "x", y: str = "y", out: str = "area_km2") -> DataFrame:
    """Area in square kilometres; groups without a proper polygon are absent."""
    pts = df.where(F.col(group).isNotNull()).select(
        F.col(group).cast("string").alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    # a hull needs only the ends of each column of points
    ends = pts.where("x IS NOT NULL AND y IS NOT NULL").groupBy("g", "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    pts = ends.select("g", "x", F.explode(F.array_distinct(F.array("a", "b"))).alias("y"))
    schema = T.StructType([
        T.StructField("g", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    ])

    def frame(hulls):
        rows = [(g, px, py) for g, corners in hulls.items() for px, py in corners]
        return pd.DataFrame(rows, columns=["g", "x", "y"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hulls: dict[str, list] = {}
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                hulls[g] = _hull(hulls.get(g, []) + list(zip(part["x"], part["y"])))
        yield frame(hulls)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame({g: _hull(list(zip(part["x"], part["y"]))) for g, part in pdf.groupby("g")})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = _hull(list(zip(pdf["x"], pdf["y"])))
        size = _area(corners) / 1e6 if len(corners) > 2 else 0.0
        return pd.DataFrame({group: [pdf["g"].iloc[0]], out: [size]})

    corners = pts.mapInPandas(partial, schema)
    salted = corners.groupBy("g", F.pmod(F.xxhash64("x", "y"), F.lit(MERGE_SALTS)).alias("salt"))
    merged = salted.applyInPandas(merge, schema)
    result = T.StructType([T.StructField(group, T.StringType()), T.StructField(out, T.DoubleType())])
    return merged.groupBy("g").applyInPandas(area, result).where(F.col(out) > 0)


def density(features: DataFrame, areas: DataFrame, group: str, n_open: str = "n_open", area: str = "area_km2") -> DataFrame:
    return features.join(areas, group, "left").withColumn("density", F.try_divide(F.col(n_open), F.col(area)))
