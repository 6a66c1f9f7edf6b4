"""Top lists, search, lookups and stable samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.text import search_fold


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def search(df: DataFrame, text: str, barrio: str, label: str = "label", area: str = "barrio", score: str = "p",
           key: str = "id", k: int = 20) -> DataFrame:
    """Accent-insensitive substring and/or exact area, best scores first.

    An empty request gives no rows.
    """
    if not text.strip() and not barrio.strip():
        return df.limit(0)
    out = df
    if barrio.strip():
        out = out.where(search_fold(area) == search_fold(F.lit(barrio)))
    if text.strip():
        out = out.where(search_fold(label).contains(search_fold(F.lit(text))))
    return top_k(out, score, key, k)


def stable_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Seeded sample of n rows that does not depend on the file layout: the n smallest digests of key and seed."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def top_groups(df: DataFrame, filters: dict[str, str], group: str, value: str, n: int) -> DataFrame:
    """Groups with the highest mean inside a filtered context."""
    for c, v in filters.items():
        df = df.where(F.col(c) == v)
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).orderBy(F.desc("mean"), group).limit(n)


def lookup(df: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested ids with their row; unknown ids are marked, not dropped."""
    found = df.withColumn("found", F.lit(1))
    return requested.select(key).distinct().join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))


def lookup_one(df: DataFrame, key: str, value) -> DataFrame:
    out = df.where(F.col(key) == value).limit(1)
    if out.isEmpty():
        raise KeyError(f"{key} {value!r} is not in the table")
    return out


def point_filter(df: DataFrame, **values) -> DataFrame:
    for c, v in values.items():
        df = df.where(F.col(c) == v)
    return df


def hits_with_destination(labelled: DataFrame, score: str, key: str, k: int, after: str = "label1") -> DataFrame:
    """Highest-scored true turnovers with the label found a year later."""
    hits = labelled.where("target = 1").withColumn(
        "destination", F.when(F.col("present"), F.col(after)).otherwise("(gone)")
    )
    return top_k(hits, score, key, k)


def sorted_export(df: DataFrame, order: Sequence) -> DataFrame:
    return df.orderBy(*order)
