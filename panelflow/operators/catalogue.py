"""Code catalogues, scenario grids and requests scored against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.numbers import request_turnover_rate
from panelflow.functions.text import match_key
from panelflow.operators.rollup import mode_per_group

# Accepted ranges of a request.
AGE_RANGE = (0.0, 120.0)
TURNOVERS_RANGE = (0, 50)
MIN_DISTINCT_BY_DISTRICT = 5
DEFAULT_DIVISION = "56"


def code_catalogue(df: DataFrame, code: str, description: str) -> DataFrame:
    """Numeric codes with their most frequent description."""
    t = df.select(F.trim(code).alias("code"), F.trim(description).alias("description"))
    t = t.where(F.col("code").rlike("^[0-9]+$"))
    named = t.where(F.col("description").isNotNull() & ~F.col("description").isin("", "nan"))
    return t.select("code").distinct().join(mode_per_group(named, ["code"], "description"), "code", "left").withColumn(
        "description", F.coalesce("description", F.concat("code", F.lit(" (no description)")))
    )


def modal_parent(df: DataFrame, code: str, parent: str) -> DataFrame:
    return mode_per_group(df, [code], parent)


def with_parent(codes: DataFrame, parents: DataFrame, code: str, parent: str, default: str = DEFAULT_DIVISION) -> DataFrame:
    return codes.join(parents.select(code, parent), code, "left").withColumn(parent, F.coalesce(parent, F.lit(default)))


def scenario_grid(codes: DataFrame, districts: Sequence[str], profiles: Sequence[dict]) -> DataFrame:
    """Every code in every district under every profile.

    The two short lists (districts, profiles) are array literals that each
    code row is exploded over; nothing is joined.
    """
    names = list(profiles[0])
    prof = F.array(*[F.struct(*[F.lit(p[n]).alias(n) for n in names]) for p in profiles])
    dist = F.array(*[F.lit(d) for d in districts])
    g = codes.withColumn("district", F.explode(dist)).withColumn("_p", F.explode(prof))
    return g.select(*codes.columns, "district", *[F.col(f"_p.{n}").alias(n) for n in names])


def varies_by_district(grid: DataFrame, by: Sequence[str], p: str, minimum: int = MIN_DISTINCT_BY_DISTRICT) -> DataFrame:
    """Guard: a scenario's score must differ between districts."""
    return grid.groupBy(*by).agg(F.count_distinct(F.round(p, 5)).alias("n_distinct")).withColumn(
        "varies", (F.col("n_distinct") >= minimum).cast("int")
    )


def validate_requests(requests: DataFrame, activities: DataFrame, divisions: DataFrame, districts: DataFrame,
                      accesses: DataFrame) -> DataFrame:
    """Mark every request with the reasons that make it invalid.

    Catalogues are one-column tables; district and access are rewritten in
    their catalogue spelling.
    """
    def known(df, catalogue, column, key, out):
        c = catalogue.select(F.col(catalogue.columns[0]).alias(out))
        c = c.groupBy(key(out).alias("_k")).agg(F.min(out).alias(out))
        return df.withColumn("_k", key(column)).join(c, "_k", "left").drop("_k")

    r = known(requests, activities, "activity", F.trim, "_activity")
    r = known(r, divisions, "division", F.trim, "_division")
    r = known(r, districts, "district", match_key, "_district")
    r = known(r, accesses, "access", match_key, "_access")
    age, turns = F.coalesce("age", F.lit(0.0)), F.coalesce("previous_turnovers", F.lit(0))
    errors = F.array_compact(
        F.array(
            F.when(F.col("_activity").isNull(), "unknown activity"),
            F.when(F.col("_division").isNull(), "unknown division"),
            F.when(F.col("_district").isNull(), "unknown district"),
            F.when(F.col("_access").isNull(), "unknown access"),
            F.when(~age.between(*AGE_RANGE), "age out of range"),
            F.when(~turns.between(*TURNOVERS_RANGE), "turnovers out of range"),
        )
    )
    return (
        r.withColumn("errors", errors)
        .withColumn("district", F.coalesce("_district", "district"))
        .withColumn("access", F.coalesce("_access", "access"))
        .withColumn("age", age).withColumn("previous_turnovers", turns)
        .withColumn("turnover_rate", request_turnover_rate("previous_turnovers", "age"))
        .drop("_activity", "_division", "_district", "_access")
    )


def correction(counts: DataFrame, n_fp: int, n_pos: int, n_fn: int, n_neg: int) -> DataFrame:
    """Churn rate corrected by reviewed label errors (one row in, one out).

    ``counts``: universe, churn, rotated, discarded.
    """
    from panelflow.functions.numbers import wilson

    c = counts.withColumn("fp", wilson(F.lit(n_fp), F.lit(n_pos))).withColumn("fn", wilson(F.lit(n_fn), F.lit(n_neg)))

    def rate(fp, fn):
        return (F.col("churn") - fp * F.col("rotated") + fn * F.col("discarded")) / F.col("universe")

    a, b = rate(F.col("fp.high"), F.col("fn.low")), rate(F.col("fp.low"), F.col("fn.high"))
    return c.select(
        (F.col("churn") / F.col("universe")).alias("observed"),
        rate(F.col("fp.rate"), F.col("fn.rate")).alias("corrected"),
        F.least(a, b).alias("low"),
        F.greatest(a, b).alias("high"),
    )


def cohort_table(churn: DataFrame, uses: dict[int, tuple[str, str]]) -> DataFrame:
    """Churn per cohort with its use and the reason it is left out.

    ``uses``: cohort -> (use, reason); cohorts not listed are excluded.
    """
    use = F.lit("excluded")
    reason = F.lit("not listed")
    for cohort, (u, why) in uses.items():
        use = F.when(F.col("cohort") == cohort, u).otherwise(use)
        reason = F.when(F.col("cohort") == cohort, why).otherwise(reason)
    out = churn.withColumn("use", use).withColumn("reason", reason)
    included = F.col("use").isin("train", "val", "test")
    return out.withColumn("included", F.when(included, "yes").otherwise("no")).withColumn(
        "detail",
        F.when(included, F.concat(F.lit("used: "), F.col("use"))).otherwise(F.concat(F.lit("excluded: "), F.col("reason"))),
    )
