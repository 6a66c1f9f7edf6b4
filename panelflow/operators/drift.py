"""Population stability index and its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelflow.operators.ordered import cut_points

FLOOR = 1e-4  # fixed value: smallest share, for both sides
OTHER = "· other ·"
MODERATE, HIGH = 0.10, 0.25  # fixed values
MIN_REQUESTS = 30  # fixed value


def _psi_bins(shares: DataFrame) -> DataFrame:
    e, o = F.greatest("expected", F.lit(FLOOR)), F.greatest("observed", F.lit(FLOOR))
    value = F.when(F.col("_seen") > 0, (o - e) * F.ln(o / e))  # nothing observed: no value
    return shares.withColumn("psi_bin", value).drop("_seen")


def _shares(e: DataFrame, o: DataFrame, bins: DataFrame) -> DataFrame:
    """Bins with expected and observed shares.

    Every row falls in one bin, so the totals are sums over the few bins and
    cost no further scan.
    """
    j = bins.join(e.withColumnRenamed("n", "_e"), "bin", "left").join(o.withColumnRenamed("n", "_o"), "bin", "left")
    every_bin = W.partitionBy(F.lit(1))
    return j.select(
        "bin",
        *[
            F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every_bin)), F.lit(0.0)).alias(name)
            for c, name in (("_e", "expected"), ("_o", "observed"))
        ],
        F.coalesce(F.sum("_o").over(every_bin), F.lit(0)).alias("_seen"),
    )


def categories_of(expected: DataFrame, column: str, top: int = 15) -> DataFrame:
    """Most frequent categories of the reference, ties by value."""
    text = F.trim(F.col(column).cast("string")).alias("bin")
    counts = expected.select(F.coalesce(text, F.lit("nan")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "bin").limit(top).select("bin")


def psi_categorical(expected: DataFrame, observed: DataFrame, column: str, top: int = 15,
                    observed_column: str | None = None) -> DataFrame:
    """PSI bins of a category: the top ones and one bin for the rest."""
    cats = categories_of(expected, column, top)

    def counts(df, c):
        v = df.select(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("nan")).alias("bin"))
        g = v.groupBy("bin").agg(F.count("*").alias("n"))
        g = g.join(F.broadcast(cats.withColumn("_in", F.lit(1))), "bin", "left")
        return g.groupBy(F.when(F.col("_in") == 1, F.col("bin")).otherwise(OTHER).alias("bin")).agg(F.sum("n").alias("n"))

    bins = cats.unionByName(cats.sparkSession.range(1).select(F.lit(OTHER).alias("bin")))
    return _psi_bins(_shares(counts(expected, column), counts(observed, observed_column or column), bins))


def psi_numeric(expected: DataFrame, observed: DataFrame, column: str, bins: int = 10,
                observed_column: str | None = None) -> DataFrame:
    """PSI bins of a number: right-closed at the distinct deciles of the
    reference, open at both ends; no rows when it has fewer than 3 edges."""
    points = cut_points(expected, column, [k / bins for k in range(bins + 1)])
    edges = sorted({e for e in points if e is not None})
    inner = edges[1:-1]
    spark = expected.sparkSession
    if len(edges) < 3:
        return spark.range(0).select(
            F.lit("").alias("bin"), *[F.lit(0.0).alias(c) for c in ("expected", "observed", "psi_bin")]
        )

    def counts(df, c):
        v = F.col(c).try_cast("double")
        b = sum(((v > e).cast("int") for e in inner), F.lit(1))
        return df.where(v.isNotNull()).groupBy(b.cast("string").alias("bin")).agg(F.count("*").alias("n"))

    frame = spark.range(1, len(edges)).select(F.col("id").cast("string").alias("bin"))
    return _psi_bins(_shares(counts(expected, column), counts(observed, observed_column or column), frame))


def total_psi(bins: DataFrame, variable: str) -> DataFrame:
    return bins.agg(F.lit(variable).alias("variable"), F.sum("psi_bin").alias("psi"))


def verdict(psi: Column) -> Column:
    return (
        F.when(psi.isNull() | F.isnan(psi), "no data").when(psi < MODERATE, "stable")
        .when(psi < HIGH, "moderate drift").otherwise("high drift")
    )


def drift_report(psis: DataFrame, n_observed: Column | int, minimum: int = MIN_REQUESTS) -> DataFrame:
    """Worst variable and overall conclusion (one row per variable in)."""
    n = F.lit(n_observed) if isinstance(n_observed, int) else n_observed
    worst = psis.agg(
        F.max("psi").alias("worst_psi"),
        F.max_by("variable", F.struct(F.coalesce("psi", F.lit(-1.0)), F.col("variable"))).alias("worst_variable"),
    ).withColumn("n_observed", n)
    conclusion = F.when(F.col("worst_psi").isNull() | (F.col("n_observed") < minimum), "no conclusion").otherwise(
        verdict(F.col("worst_psi"))
    )
    return worst.withColumn("conclusion", conclusion)
