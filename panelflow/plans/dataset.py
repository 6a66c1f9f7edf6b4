"""Modelling dataset and area panel as one plan over all cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators import areas, history, pairs, rollup
from panelflow.operators.brand import brand_features
from panelflow.operators.neighbourhood import neighbourhoods
from panelflow.session import materialise

HISTORY = ["business_age", "premises_age", "previous_turnovers", "turnover_rate", "age_censored"]
NEAR = ["n_150m", "competitors_200m", "vacancy_150m", "diversity_150m", "competition_200m", "turnover_150m"]
BRAND = ["same_brand", "is_chain", "in_mall", "mall_size", "label_length", "label_words"]
SECTOR, MACRO, ACCESS = ["activity", "division"], ["district"], ["access"]
# Fixed values. Candidate feature sets: name -> (numeric, categorical)
CANDIDATES: dict[str, tuple[list[str], list[str]]] = {
    "A sector": ([], SECTOR),
    "B sector + district": ([], SECTOR + MACRO),
    "C sector + district + history": (HISTORY, SECTOR + MACRO + ACCESS),
    "D complete": (HISTORY + NEAR, SECTOR + MACRO + ACCESS),
    "E no sector": (HISTORY + NEAR, MACRO + ACCESS),
    "F sector + district + history + brand": (HISTORY + BRAND, SECTOR + MACRO + ACCESS),
    "G history + income": ([*HISTORY, "income"], SECTOR + MACRO + ACCESS),
}
COLUMNS = ["id", "cohort", "use", "target", *HISTORY, *NEAR, *BRAND, "access", "division", "section", "activity", "district", "barrio", "label"]
MIN_POINTS = 100  # fixed value: snapshots with fewer points get no neighbourhood


def space_features(panel: DataFrame, hist: DataFrame | None = None, near: float = 150.0, far: float = 200.0,
                   minimum: int = MIN_POINTS, split: int | None = None) -> DataFrame:
    """Six neighbourhood variables per (id, anio)."""
    from panelflow.operators.clean import valid_point

    pts = panel.where(valid_point("x", "y")).select("id", "anio", "x", "y", "division", "open")
    enough = pts.groupBy("anio").agg(F.count("*").alias("_k")).where(F.col("_k") >= minimum).select("anio")
    pts = pts.join(F.broadcast(enough), "anio", "left_semi")  # one row per snapshot
    weight = None
    if hist is not None:
        pts = pts.join(hist.select("id", "anio", "turnovers"), ["id", "anio"], "left")
        weight = "turnovers"
    out = neighbourhoods(pts, {"_150m": near, "_200m": far}, weight=weight, split=split)
    return out.select("id", "anio", *NEAR)


def modelling_dataset(panel: DataFrame, uses: Mapping[int, str], start: int, vocabulary: Sequence[str] | None = None,
                      fuzzy: bool = True, blocks: Sequence[str] = ("history", "space", "brand"), hist: DataFrame | None = None) -> DataFrame:
    """One row per (id, cohort): label, split and the requested feature blocks.

    No feature reads a year after the cohort's own.  ``hist`` is ``history_as_of`` of the panel, where it is stored already.
    """
    use = F.lit(None).cast("string")
    for cohort, name in uses.items():
        use = F.when(F.col("cohort") == cohort, name).otherwise(use)
    u = pairs.label_pairs(panel, vocabulary, fuzzy=fuzzy).withColumn("use", use).where(F.col("use").isNotNull())
    if hist is None:
        hist = history.history_as_of(panel, vocabulary, fuzzy=fuzzy, start=start)
        if "space" in blocks:
            hist = materialise(hist, "history")  # joined twice
    if "history" in blocks:
        u = u.join(hist.withColumnRenamed("anio", "cohort"), ["id", "cohort"], "left")
        u = history.derived_ages(u, F.col("cohort"), F.lit(start))
    return with_surroundings(u, panel, hist, vocabulary, blocks)


def with_surroundings(u: DataFrame, panel: DataFrame, hist: DataFrame, vocabulary: Sequence[str] | None = None,
                      blocks: Sequence[str] = ("space", "brand")) -> DataFrame:
    """The dataset's rows with the blocks that other premises of the snapshot decide."""
    if "space" in blocks:
        u = u.join(space_features(panel, hist).withColumnRenamed("anio", "cohort"), ["id", "cohort"], "left")
    if "brand" in blocks:
        u = u.join(brand_features(panel, vocabulary).withColumnRenamed("anio", "cohort"), ["id", "cohort"], "left")
        u = u.fillna(0, subset=BRAND)
    return u.select(*[c for c in COLUMNS if c in u.columns])


def scoring_universe(panel: DataFrame, year: int, window: int = 3, vocabulary: Sequence[str] | None = None,
                     fuzzy: bool = True, blocks: Sequence[str] = ("history",)) -> DataFrame:
    """Open, informative premises of the last snapshot with a history window
    as short as the training cohorts had; only the wanted blocks are computed."""
    u = panel.where((F.col("anio") == year) & F.col("open") & pairs.informative("norm", vocabulary))
    start = year - window
    if "history" in blocks:
        h = history.history(panel, year, start, vocabulary, fuzzy)
        u = history.derived_ages(u.join(h, "id", "left"), F.lit(year), F.lit(start))
    if "space" in blocks:
        h = history.history_as_of(panel.where(F.col("anio") <= year), vocabulary, fuzzy, start)
        u = u.join(space_features(panel.where(F.col("anio") == year), h), ["id", "anio"], "left")
    if "brand" in blocks:
        u = u.join(brand_features(panel.where(F.col("anio") == year), vocabulary), ["id", "anio"], "left")
    return u.withColumn("cohort", F.lit(year))


def area_churn(labelled: DataFrame, area: str = "barrio") -> DataFrame:
    return labelled.groupBy(area, "cohort").agg(F.count("*").alias("n_universe"), F.avg("target").alias("churn"))


def area_panel(panel: DataFrame, labelled: DataFrame, area: str = "barrio",
               section: str = "division", with_density: bool = True) -> DataFrame:
    """Area x year regression panel: composition, density, last year's churn,
    mean of all earlier years and the churn to predict."""
    churn = area_churn(labelled, area)
    feats = rollup.area_features(panel, [area, "anio"]).withColumnRenamed("anio", "cohort")
    shares = rollup.composition(panel.where("open").withColumnRenamed("anio", "cohort"), [area, "cohort"], section)
    mix = rollup.wide_composition(shares, [area, "cohort"], section)
    past = history.expanding_mean(
        history.previous_year(churn, area, "cohort", "churn", "churn_previous"), area, "cohort", "churn", "churn_mean"
    )
    out = feats.join(mix, [area, "cohort"], "left").join(
        past.select(area, "cohort", F.col("churn").alias("objective"), "churn_previous", "churn_mean"), [area, "cohort"]
    )
    if with_density:
        out = areas.density(out, areas.hull_areas(panel, area), area)
    return out.where(F.col("objective").isNotNull())
