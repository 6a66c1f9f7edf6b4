"""Joining an external income series by section, area and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.numbers import grouped_number
from panelflow.functions.text import match_key
from panelflow.operators.history import carry_forward
from panelflow.operators.ordered import cut_points
from panelflow.operators.rollup import mode_per_group

MUNICIPALITY = "28079"  # fixed value: code prefix of the city


def first_word_tail(col: str, n: int) -> Column:
    """Last n characters of the first word: the code inside a description."""
    return F.right(F.element_at(F.split(F.trim(col), r"\s+"), 1), F.lit(n))


def split_income(rows: DataFrame, indicator: str) -> tuple[DataFrame, DataFrame]:
    """(section rows, district rows) of one indicator of the city."""
    base = rows.where(
        F.col("municipality").startswith(MUNICIPALITY) & (F.col("indicator") == indicator)
    ).withColumn("year", F.col("period").cast("int")).withColumn("income", grouped_number("total"))
    has_section = F.coalesce(F.trim("section") != "", F.lit(False))
    has_district = F.coalesce(F.trim("district") != "", F.lit(False))
    sections = base.where(has_section).withColumn("code", first_word_tail("section", 5))
    districts = base.where(~has_section & has_district).withColumn("code", first_word_tail("district", 2))
    return sections, districts


def section_map(panel: DataFrame, section: str, area: str, district: str) -> DataFrame:
    """Section code -> modal area and district (ties: smallest name)."""
    p = panel.where(F.col(section).isNotNull()).select(
        F.lpad(F.trim(section), 5, "0").alias("code"), match_key(area).alias("area"), match_key(district).alias("district")
    )
    areas = mode_per_group(p, ["code"], "area")
    return areas.join(mode_per_group(p, ["code"], "district"), "code")


def income_by_area_year(sections: DataFrame, mapping: DataFrame, last_year: int, until: int) -> DataFrame:
    """Plain mean of the sections of an area; the last year is carried on."""
    g = sections.where(F.col("income").isNotNull()).join(mapping, "code").groupBy("area", "year").agg(
        F.avg("income").alias("income")
    )
    return carry_forward(g, "area", "year", "income", last_year, until)


def income_by_district_year(districts: DataFrame, mapping: DataFrame, last_year: int, until: int) -> DataFrame:
    names = mode_per_group(mapping.select(F.left("code", F.lit(2)).alias("code"), "district"), ["code"], "district")
    g = districts.where(F.col("income").isNotNull()).select("code", "year", "income").join(names, "code")
    g = g.groupBy("district", "year").agg(F.avg("income").alias("income"))
    return carry_forward(g, "district", "year", "income", last_year, until)


def attach_income(data: DataFrame, by_area: DataFrame, by_district: DataFrame, area: str, district: str, year: str) -> DataFrame:
    """Fallback chain area-year -> district-year -> overall median.

    The median needs the rows per (area, district, year) only, so ``data`` is
    read once for those counts and once for the result.
    """
    a = by_area.select(F.col("area").alias("_area"), F.col("year").alias(year), F.col("income").alias("_ia"))
    b = by_district.select(F.col("district").alias("_district"), F.col("year").alias(year), F.col("income").alias("_ib"))

    def known(df: DataFrame) -> DataFrame:
        df = df.withColumn("_area", match_key(area)).withColumn("_district", match_key(district))
        return df.join(a, ["_area", year], "left").join(b, ["_district", year], "left").withColumn("_known", F.coalesce("_ia", "_ib"))

    counts = known(data.groupBy(area, district, year).agg(F.count("*").alias("_rows")))
    median = F.lit(cut_points(counts, "_known", [0.5], "_rows")[0]).cast("double")
    d = known(data)
    source = F.when(F.col("_ia").isNotNull(), "area").when(F.col("_ib").isNotNull(), "district").otherwise("median")
    return d.withColumn("income", F.coalesce(F.col("_known"), median)).withColumn("income_source", source).drop(
        "_area", "_district", "_ia", "_ib", "_known"
    )


def income_coverage(panel: DataFrame, section: str, area: str, year: str, sections: DataFrame, by_area: DataFrame) -> DataFrame:
    """Per year: share of open premises whose section / area-year has income."""
    known = sections.where(F.col("income").isNotNull()).select(F.col("code").alias("_code")).distinct()
    pairs = by_area.select(F.col("area").alias("_area"), F.col("year").alias("_y")).distinct()
    p = panel.where("open").select(
        year, F.lpad(F.trim(section), 5, "0").alias("_code"), match_key(area).alias("_area"), F.col(year).alias("_y")
    )
    p = p.join(known.withColumn("_s", F.lit(1)), "_code", "left").join(
        pairs.withColumn("_b", F.lit(1)), ["_area", "_y"], "left"
    )
    return p.groupBy(year).agg(
        F.count("*").alias("n_open"),
        F.avg(F.coalesce("_s", F.lit(0)).cast("double")).alias("by_section"),
        F.avg(F.coalesce("_b", F.lit(0)).cast("double")).alias("by_area"),
    )
