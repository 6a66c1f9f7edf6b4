"""Exact evaluation statistics of scored tables.

Ranking metrics work on the table of distinct scores (count and positives per
score), so a score shared by many rows is a single row, and on distributed
prefix sums, so no task sees the whole ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelflow.functions.numbers import left_closed_bin, right_closed_bin
from panelflow.operators.ordered import (
    cut_points, exact_quantiles, rank_buckets, row_numbers, running, sliced, value_table, with_row,
)

# Calibration bins of the two reports.
CALIBRATION_RIGHT_CLOSED = (0.0, 0.02, 0.04, 0.06, 0.08, 0.12, 1.0)
CALIBRATION_LEFT_CLOSED = (0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 1.0)


def top_n(total: Column, q: float) -> Column:
    """Rows in the top share ``q``: at least one."""
    return F.greatest(F.lit(1), F.floor(total * q))


def metrics_from_values(values: DataFrame, by: Sequence[str] = (), q: float = 0.10) -> DataFrame:
    """AUC, average precision, Brier, lift and base rate per group.

    ``values``: group columns, ``p``, ``n`` rows and ``pos`` positives of that
    score, unique per (group, p).  Ties count half in the AUC; average
    precision steps once per distinct score; the lift shares a tie at the cut
    proportionally.
    """
    r = running(sliced(values, ["p"]), ["p"], {"n_below": "n", "pos_below": "pos"}, by)
    tot = values.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    if by:
        r = r.join(tot, list(by))
    else:
        r = with_row(r, tot)
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    total, hits = F.col("_n").cast("double"), F.col("_pos").cast("double")
    neg_below = (F.col("n_below") - F.col("pos_below")).cast("double")
    n_above = total - F.col("n_below") - n
    pos_above = hits - F.col("pos_below") - pos
    cut = top_n(F.col("_n"), q)
    inside = F.least(F.greatest(cut - n_above, F.lit(0.0)), n)
    return r.groupBy(*by).agg(
        F.first("_n").alias("n"),
        F.first("_pos").alias("positives"),
        F.first(hits / total).alias("base_rate"),
        F.try_divide(F.sum(pos * (neg_below + (n - pos) / 2)), F.first(hits * (total - hits))).alias("auc"),
        F.try_divide(
            F.sum(F.when(pos > 0, pos * (pos_above + pos) / (n_above + n)).otherwise(0.0)), F.first(hits)
        ).alias("average_precision"),
        (F.sum(pos * F.pow(1 - F.col("p"), 2) + (n - pos) * F.pow(F.col("p"), 2)) / F.first(total)).alias("brier"),
        F.try_divide(F.sum(pos * inside / n) / F.first(cut), F.first(hits / total)).alias("lift"),
    )


def ranking_metrics(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), q: float = 0.10, weight: str | None = None) -> DataFrame:
    """``weight``: rows that a row stands for."""
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    src = df.select(*by, F.col(p).alias("p"), n.alias("_n"), (F.col(y).cast("long") * n if weight else F.col(y).cast("long")).alias("_y"))
    values = value_table(src, "p", {"n": F.col("_n"), "pos": F.col("_y")}, by)
    return metrics_from_values(values, by, q)


def brier(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def lift_by_rank(df: DataFrame, y: str = "y", p: str = "p", key: str = "id", q: float = 0.10) -> DataFrame:
    """Lift of the top share by (score desc, id): ties broken by id."""
    r = row_numbers(df.select(key, F.col(p).alias("_p"), F.col(y).alias("_y")), [F.desc("_p"), key], "_rn")
    total = r.agg(F.count("*")).scalar()
    top = r.withColumn("_cut", top_n(total, q))
    return top.agg(
        F.count_if(F.col("_rn") <= F.col("_cut")).alias("n_top"),
        (F.avg(F.when(F.col("_rn") <= F.col("_cut"), F.col("_y"))) / F.avg("_y")).alias("lift"),
    )


def precision_at(df: DataFrame, k: int, y: str = "y", p: str = "p", key: str = "id") -> DataFrame:
    """Hits among the k highest scores (k is a report size)."""
    top = df.orderBy(F.desc(p), key).limit(k)
    return top.agg(F.sum(F.col(y).cast("long")).alias("hits"), F.avg(y).alias("precision"))


def decile_table(df: DataFrame, y: str = "y", p: str = "p", key: str = "id", buckets: int = 10) -> DataFrame:
    base = df.agg(F.avg(y)).scalar()
    t = rank_buckets(df.select(key, F.col(p).alias("_p"), F.col(y).alias("_y")), "_p", key, buckets)
    return t.groupBy("decile").agg(
        F.count("*").alias("n"), F.sum(F.col("_y").cast("long")).alias("hits"), F.avg("_y").alias("rate")
    ).withColumn("lift", F.col("rate") / base)


def calibration_table(df: DataFrame, edges: Sequence[float] = CALIBRATION_RIGHT_CLOSED, right_closed: bool = True,
                      minimum: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    """Predicted and observed mean per score bin; the edge rule matters."""
    b = right_closed_bin(p, edges) if right_closed else left_closed_bin(p, edges)
    t = df.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed")
    )
    return t.where(F.col("n") >= minimum)


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE and R2 against the mean of y (two passes: means, then residuals)."""
    if by:
        m = df.groupBy(*by).agg(F.avg(y).alias("_m"))
        d = df.join(m, list(by))
    else:
        d = df.withColumn("_m", df.agg(F.avg(y)).scalar())
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"),
        (1 - F.try_divide(F.sum(F.pow(F.col(y) - F.col(p), 2)), F.sum(F.pow(F.col(y) - F.col("_m"), 2)))).alias("r2"),
    )


def baseline_verdicts(metrics: DataFrame, model: str, baseline: str) -> DataFrame:
    """Compare every model row (mae, r2) with the baseline row."""
    base = metrics.where(F.col(model) == baseline).select(F.col("mae").alias("_mae"), F.col("r2").alias("_r2"))
    j = with_row(metrics.where(F.col(model) != baseline), base)
    d_mae, d_r2 = F.col("mae") - F.col("_mae"), F.col("r2") - F.col("_r2")
    verdict = (
        F.when((d_mae < 0) & (d_r2 > 0), "better").when(d_mae >= 0, "does not beat baseline").otherwise("mixed")
    )
    return j.select(model, d_mae.alias("d_mae"), d_r2.alias("d_r2"), verdict.alias("verdict"))


def average_ranks(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank with ties, for tables of areas (one row per area)."""
    part = list(by) or [F.lit(1)]
    r = F.rank().over(W.partitionBy(*part).orderBy(value))
    ties = F.count("*").over(W.partitionBy(*part, value))
    return df.withColumn(out, r + (ties - 1) / 2)


def spearman_of_areas(areas: DataFrame, observed: str = "observed", predicted: str = "predicted",
                      by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation between observed and predicted area means, with the
    t statistic of the usual large-sample test."""
    r = average_ranks(average_ranks(areas, observed, "_ro", by), predicted, "_rp", by)
    g = r.groupBy(*by).agg(F.count("*").alias("n_areas"), F.corr("_ro", "_rp").alias("rho"))
    return g.withColumn(
        "t", F.try_divide(F.col("rho") * F.sqrt(F.col("n_areas") - 2.0), F.sqrt(1 - F.col("rho") * F.col("rho")))
    )


def area_means(df: DataFrame, area: str, y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(area).agg(F.avg(y).alias("observed"), F.avg(p).alias("predicted"))


def value_quintiles(df: DataFrame, value: str, k: int = 5, out: str = "quintile") -> DataFrame:
    """Right-closed buckets at the value quantiles: equal values stay together."""
    bucket = F.when(F.col(value).isNull(), None)
    for i, edge in enumerate(cut_points(df, value, [i / k for i in range(1, k)]), start=1):
        bucket = bucket.when(F.col(value) <= F.lit(edge).cast("double"), i)
    return df.withColumn(out, bucket.otherwise(k).cast("int"))


def reference_decile(new: DataFrame, reference: DataFrame, p: str = "p", out: str = "decile") -> DataFrame:
    """Decile of new scores in a reference distribution.

    ``min(floor(10 * share strictly below) + 1, 10)``.  The nine score values
    where the decile steps up are order statistics of the reference; every
    new row is compared with them only.
    """
    t = value_table(reference.where(F.col(p).isNotNull()).select(F.col(p).alias("_v")), "_v", {"n": F.lit(1).cast("long")})
    r = running(sliced(t, ["_v"]), ["_v"], {"below": "n"})
    total = t.agg(F.sum("n")).scalar()
    # a score s reaches decile k+1 when the rows below s are at least k/10 of all
    upto = F.col("below") + F.col("n")
    r = r.withColumn("_total", total)
    steps = r.agg(
        *[F.min(F.when(F.floor(10 * upto / F.col("_total")) >= k, F.col("_v"))).alias(f"s{k}") for k in range(1, 10)]
    )
    j = with_row(new, steps)
    reached = sum((F.coalesce((F.col(p) > F.col(f"s{k}")).cast("int"), F.lit(0)) for k in range(1, 10)), F.lit(1))
    return j.withColumn(out, F.when(F.col(p).isNotNull(), reached).cast("int")).drop(*[f"s{k}" for k in range(1, 10)])


def is_monotone(deciles: DataFrame, value: str = "rate", order: str = "decile") -> DataFrame:
    """Does the rate never fall from one decile to the next (ten rows)?"""
    w = W.partitionBy(F.lit(1)).orderBy(order)
    d = deciles.withColumn("_prev", F.lag(value).over(w))
    return d.agg(
        F.count_if(F.col(value) < F.col("_prev")).alias("n_drops"),
        F.every(F.coalesce(F.col(value) >= F.col("_prev"), F.lit(True))).cast("int").alias("monotone"),
    )


def typical_rows(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Row of every group closest to the group's median score."""
    med = exact_quantiles(df, score, {"median": 0.5}, [group])
    rest = [c for c in df.columns if c != group]
    return df.join(med, group).groupBy(group).agg(
        F.min_by(F.struct(*rest), F.struct(F.abs(F.col(score) - F.col("median")), F.col(key))).alias("_r")
    ).select(group, "_r.*")


def ensemble(scored: DataFrame, columns: Sequence[str], out: str = "p_vote") -> DataFrame:
    """Soft vote: mean of the given scores of a row."""
    return scored.withColumn(out, sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns))
