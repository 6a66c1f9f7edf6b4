"""File sources: register snapshots, series, catalogues and small documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.text import fold

# Encodings in the order they are tried.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
# Month names of the catalogue descriptions.
MONTHS = [
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO",
    "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
]
FILE_DATE = r"_(\d{4})_(\d{2})\.csv"  # in the name of the file or of its folder


def clean_header(names: Sequence[str]) -> list[str]:
    return [n.replace("﻿", "").strip().lower() for n in names]


def _c1_controls() -> tuple[str, str, str]:
    """(defined C1 bytes, their cp1252 characters, undefined C1 bytes)."""
    defined, chars, undefined = "", "", ""
    for byte in range(0x80, 0xA0):
        try:
            chars += bytes([byte]).decode("cp1252")
            defined += chr(byte)
        except UnicodeDecodeError:
            undefined += chr(byte)
    return defined, chars, undefined


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that can hold the file.

    Distributed passes that stop at the first offending line: UTF-8 unless it
    shows replacement characters, cp1252 unless one of the bytes it leaves
    undefined occurs, else latin-1, which never fails.
    """
    def lines(charset):
        return spark.read.options(encoding=charset, sep="\u0001", quote="").csv(path, schema="line string")

    if lines("UTF-8").where(F.col("line").contains("\ufffd")).isEmpty():
        return ENCODINGS[0]
    undefined = "|".join(f"\\x{ord(c):02x}" for c in _c1_controls()[2])
    if lines("ISO-8859-1").where(F.col("line").rlike(undefined)).isEmpty():
        return ENCODINGS[1]
    return ENCODINGS[2]


def _scan(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """All-string CSV scan.  cp1252 is read as its superset of bytes and the
    few characters that differ are translated."""
    charset = "UTF-8" if encoding.lower().startswith("utf") else "ISO-8859-1"
    raw = spark.read.options(sep=sep, header=True, encoding=charset, inferSchema=False).csv(path)
    if encoding != "cp1252":
        return raw
    controls, chars, _ = _c1_controls()
    return raw.withColumns({c: F.translate(F.col(f"`{c}`"), controls, chars) for c in raw.columns})


def sniff_separator(spark: SparkSession, path: str, candidates: Sequence[str] = (";", ",", "\t")) -> str:
    """Separator that splits the header line most often."""
    head = spark.read.text(path).limit(1).first()
    header = head[0] if head else ""
    return max(candidates, key=lambda c: (header.count(c), -candidates.index(c)))


def header_columns(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8") -> list[str]:
    """Column names only; no data row is read."""
    return clean_header(_scan(spark, path, sep, encoding).columns)


def read_snapshot_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ";",
                      encoding: str | None = None) -> DataFrame:
    """All-string scan with cleaned headers; codes keep their zeros."""
    encoding = encoding or sniff_encoding(spark, path)
    raw = _scan(spark, path, sep, encoding)
    df = raw.toDF(*clean_header(raw.columns))
    return df.select(*columns) if columns else df


def file_period(path: Column) -> tuple[Column, Column]:
    """(year, month) in the path of a snapshot file."""
    return (
        F.regexp_extract(path, FILE_DATE, 1).try_cast("int"),
        F.regexp_extract(path, FILE_DATE, 2).try_cast("int"),
    )


def read_snapshot_files(spark: SparkSession, paths: Sequence[str], required: Sequence[str], optional: Sequence[str] = (),
                        sep: str = ";") -> DataFrame:
    """All yearly files in one frame with ``anio`` and ``mes``.

    Files are united by column name: a year without an optional column gets
    nulls.  A file without a required column stops the load.
    """
    out = None
    for path in sorted(paths):
        encoding = sniff_encoding(spark, path)
        raw = _scan(spark, path, sep, encoding)
        year, month = file_period(F.col("_metadata.file_path"))
        df = raw.withColumn("__anio", year).withColumn("__mes", month)
        df = df.toDF(*clean_header(raw.columns), "anio", "mes")
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        keep = [c for c in (*required, *optional) if c in df.columns]
        df = df.select(*keep, "anio", "mes")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def schema_audit(headers: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Audit of (file, column) rows: where each wanted column is present.

    ``usable``: required, or optional and present in every file.
    """
    n_files = headers.agg(F.count_distinct("file")).scalar()
    wanted = headers.sparkSession.createDataFrame(
        [(c, True) for c in required] + [(c, False) for c in optional], "column string, required boolean"
    )
    present = headers.groupBy("column").agg(F.count_distinct("file").alias("n_files"))
    out = wanted.join(present, "column", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    out = out.withColumn("total", n_files)
    everywhere = F.col("n_files") == F.col("total")
    return out.select(
        "column", F.col("required").cast("int").alias("required"), "n_files",
        (F.col("total") - F.col("n_files")).alias("n_missing"),
        (F.col("required") | everywhere).cast("int").alias("usable"),
    )


def header_table(spark: SparkSession, paths: Sequence[str], sep: str = ";") -> DataFrame:
    rows = [(p.rsplit("/", 1)[-1], c) for p in paths for c in header_columns(spark, p, sep)]
    return spark.createDataFrame(rows, "file string, column string")


def read_panel(spark: SparkSession, path: str, years: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Panel table; year filter prunes partitions, columns prune the scan."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.where(F.col("anio").isin(list(years)))
    return df.select(*columns) if columns else df


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored-table CSV with declared types; the id stays text."""
    schema = (
        "id string, label string, activity string, district string, barrio string, x double, y double, p double, decile int"
    )
    return spark.read.schema(schema).option("header", True).csv(path)


def read_income_csv(spark: SparkSession, path: str) -> DataFrame:
    names = ["municipality", "district", "section", "indicator", "period", "total"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).options(sep=";", header=True, encoding="UTF-8").csv(path)


def month_number(name: Column) -> Column:
    months = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(k))])
    return F.try_element_at(months, fold(name))


def parse_description(description: str) -> tuple[Column, Column, Column]:
    """(kind, year, month) of text like ``Actividades. Diciembre 2023``."""
    d = F.trim(description)
    kind = F.lower(F.regexp_extract(d, r"^([^.]+)\.", 1))
    return (
        F.nullif(kind, F.lit("")),
        F.regexp_extract(d, r"(\d{4})\s*$", 1).try_cast("int"),
        month_number(F.regexp_extract(d, r"(\p{L}+)\s+\d{4}\s*$", 1)),
    )


def catalogue_from_descriptions(df: DataFrame) -> DataFrame:
    """Resource rows (description, url, bytes) to a typed catalogue."""
    kind, year, month = parse_description("description")
    return df.select(
        kind.alias("kind"), year.alias("anio"), month.alias("mes"), "url", (F.col("bytes") / 1e6).alias("mb")
    ).where(F.col("anio").isNotNull())


def read_catalogue_xml(spark: SparkSession, path: str) -> DataFrame:
    """CSV distributions of an RDF/XML catalogue."""
    schema = (
        "`dct:title` string, `dcat:accessURL` string, `dcat:mediaType` string, `dcat:byteSize` string"
    )
    raw = spark.read.format("xml").option("rowTag", "dcat:Distribution").schema(schema).load(path)
    csv = raw.where(F.lower("`dcat:mediaType`").contains("csv"))
    return catalogue_from_descriptions(
        csv.select(
            F.col("`dct:title`").alias("description"), F.col("`dcat:accessURL`").alias("url"),
            F.col("`dcat:byteSize`").try_cast("double").alias("bytes"),
        )
    )


def availability(catalogue: DataFrame) -> DataFrame:
    """Year -> sorted list of published months (at most twelve)."""
    return catalogue.groupBy("anio").agg(F.array_join(F.sort_array(F.collect_set("mes")), ",").alias("months"))


def review_state(reviewed: DataFrame, column: str) -> DataFrame:
    """Counts that tell an unjudged, half-judged or wrong review apart."""
    v = F.trim(F.col(column).cast("string"))
    number = v.try_cast("double")
    return reviewed.agg(
        F.count("*").alias("n"),
        F.count_if(v.isNull() | (v == "")).alias("n_empty"),
        F.count_if((v != "") & (number.isNull() | ~number.isin(0.0, 1.0))).alias("n_bad"),
        F.count_if(number == 1).alias("n_yes"),
    )


def read_review(reviewed: DataFrame, column: str) -> DataFrame | None:
    """Judged sample with 0/1 verdicts; None while nobody has judged it."""
    s = review_state(reviewed, column).first()
    if s["n_empty"] == s["n"]:
        return None
    if s["n_empty"] or s["n_bad"]:
        raise ValueError(f"review of {column}: {s['n_empty']} empty, {s['n_bad']} not 0/1")
    return reviewed.withColumn(column, F.trim(F.col(column).cast("string")).cast("double").cast("int"))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
