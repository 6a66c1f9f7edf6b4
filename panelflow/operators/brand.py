"""Brand and site descriptors of the label, computed inside one snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.text import core_key, raw_length, word_count

CHAIN_SIZE = 3  # fixed value: premises that make a chain
NULL_WORDS = ["", "nan", "none", "<na>"]  # fixed values: text forms of null


def group_size(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Size of the group every row belongs to.

    An aggregate joined back instead of a window: the sizes are one row per
    group, and a group with a third of all rows is split by the skew join.
    """
    return df.join(df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count("*").alias(out)), keys, "left")


def brand_features(panel: DataFrame, vocabulary: Sequence[str] | None = None) -> DataFrame:
    """Six descriptors per (id, anio)."""
    p = panel.select(
        "id",
        "anio",
        F.nullif(core_key("norm", vocabulary), F.lit("")).alias("_brand"),
        F.when(~F.lower(F.trim("mall")).isin(NULL_WORDS), F.trim("mall")).alias("_mall"),
        raw_length("label").alias("label_length"),
        word_count("norm").alias("label_words"),
    )
    p = group_size(p, ["anio", "_brand"], "same_brand")
    p = group_size(p, ["anio", "_mall"], "mall_size")
    same = F.coalesce("same_brand", F.lit(1))
    return p.select(
        "id",
        "anio",
        same.alias("same_brand"),
        (same >= CHAIN_SIZE).cast("int").alias("is_chain"),
        F.col("_mall").isNotNull().cast("int").alias("in_mall"),
        F.coalesce("mall_size", F.lit(0)).alias("mall_size"),
        "label_length",
        "label_words",
    )
