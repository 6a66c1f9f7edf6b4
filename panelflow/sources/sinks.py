"""Sinks: partitioned tables, two-locale CSV, single files and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def write_panel(df: DataFrame, path: str, by: str = "anio", mode: str = "overwrite") -> None:
    """One folder per year; rows of a year are spread over several files."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_dataset(df: DataFrame, path: str, columns: Sequence[str], by: str = "cohort") -> None:
    """Fixed column order, keeping only the columns that exist."""
    keep = [c for c in columns if c in df.columns]
    df.select(*keep).write.mode("overwrite").partitionBy(by).parquet(path)


def localised(df: DataFrame, decimal: str = ",") -> DataFrame:
    """Numbers as text with the given decimal mark."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and decimal != ".":
            c = F.translate(c.cast("string"), ".", decimal)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_bom(df: DataFrame) -> DataFrame:
    """Byte-order mark in front of the header, as spreadsheets expect it."""
    first = df.columns[0]
    return df.withColumnRenamed(first, BOM + first)


def write_two_locales(df: DataFrame, path: str, single_file: bool = False) -> None:
    """``path`` with , and . and ``path_es`` with ; and decimal comma.

    A folder of files; ``single_file`` is for rollups.
    """
    for suffix, sep, decimal in (("", ",", "."), ("_es", ";", ",")):
        out = with_bom(localised(df, decimal))
        out = out.coalesce(1) if single_file else out
        out.write.mode("overwrite").options(header=True, sep=sep, encoding="UTF-8").csv(path + suffix)


def write_single_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One file, written by one task: the caller's choice, for rollups."""
    df.coalesce(1).write.mode("overwrite").options(header=True, sep=sep).csv(path)


def export_spatial_input(panel: DataFrame, path: str, columns: Sequence[str] = ("id", "x", "y", "division", "open")) -> None:
    """Points with decimal dots for another engine."""
    numbers = {c for c in ("x", "y") if c in columns}
    out = panel.select(*[
        F.translate(F.col(c).cast("string"), ",", ".").alias(c) if c in numbers else F.col(c) for c in columns
    ])
    out.write.mode("overwrite").options(header=True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append prediction-log rows, partitioned by day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_summary(row: DataFrame, path: str) -> None:
    """One-row summary as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)
