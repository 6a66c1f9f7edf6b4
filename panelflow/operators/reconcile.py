"""Reconciliation of two result tables by key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO_TOLERANCE = 1e-9  # fixed value


def _equal(a: Column, b: Column, tolerance: float) -> Column:
    if tolerance == 0:
        return a.eqNullSafe(b)
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def _joined(left: DataFrame, right: DataFrame, key: list[str], columns) -> DataFrame:
    r = right.select(*key, *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.select(*key, *[F.col(c).alias(f"{c}_a") for c in columns]).join(r, key)


def compare(left: DataFrame, right: DataFrame, key: list[str], tolerances: Mapping[str, float]) -> DataFrame:
    """Per variable: rows compared, rows equal and the largest difference."""
    j = _joined(left, right, key, tolerances)
    agg = j.agg(
        *[
            F.struct(
                F.lit(c).alias("variable"), F.count("*").alias("n"),
                F.count_if(_equal(F.col(f"{c}_a"), F.col(f"{c}_b"), t)).alias("n_equal"),
                F.max(F.abs(F.col(f"{c}_a").cast("double") - F.col(f"{c}_b").cast("double"))).alias("max_difference"),
            ).alias(c)
            for c, t in tolerances.items()
        ]
    )
    return agg.select(F.explode(F.array(*tolerances)).alias("r")).select("r.*")


def differing_rows(left: DataFrame, right: DataFrame, key: list[str], tolerances: Mapping[str, float], n: int = 5) -> DataFrame:
    bad = F.lit(False)
    for c, t in tolerances.items():
        bad = bad | ~_equal(F.col(f"{c}_a"), F.col(f"{c}_b"), t)
    return _joined(left, right, key, tolerances).where(bad).orderBy(*key).limit(n)


def only_in(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.select(*key).distinct().join(right.select(*key).distinct(), key, "left_anti")


def one_sided(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys missing on either side, with the side that has them."""
    return only_in(left, right, key).withColumn("side", F.lit("left")).unionByName(
        only_in(right, left, key).withColumn("side", F.lit("right"))
    )


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)
