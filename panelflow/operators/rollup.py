"""Aggregations over panels, labelled cohorts and scored tables.

Everything is a two-phase aggregate; quantiles that could meet an unbounded
group go through ``ordered.exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelflow.functions.numbers import right_closed_bin, round_half_even
from panelflow.functions.text import normalise
from panelflow.operators.ordered import exact_quantiles, row_numbers, running, sliced, with_row


def official_vocabulary(df: DataFrame, columns: Sequence[str], min_length: int = 4) -> DataFrame:
    """Distinct words of the activity descriptions, as ``word``."""
    texts = None
    for c in columns:
        t = df.select(F.col(c).alias("t")).distinct()
        texts = t if texts is None else texts.unionByName(t)
    words = texts.select(F.explode(F.split(normalise("t"), " ")).alias("word")).where(F.length("word") >= min_length)
    return words.distinct()


def union_words(*vocabularies: DataFrame) -> DataFrame:
    out = vocabularies[0]
    for v in vocabularies[1:]:
        out = out.unionByName(v)
    return out.distinct()


def spread(df: DataFrame, value: str) -> DataFrame:
    return df.agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std")
    )


def size_sum_mean(df: DataFrame, by: Sequence[str], target: str = "target", grand_totals: bool = False) -> DataFrame:
    g = df.rollup(*by) if grand_totals else df.groupBy(*by)
    return g.agg(F.count("*").alias("n"), F.sum(target).alias("hits"), F.avg(target).alias("rate"))


def rate_by_bins(df: DataFrame, value: str, edges: Sequence[float], target: str = "target") -> DataFrame:
    """Rate per right-closed bin of ``value``."""
    b = df.withColumn("bin", right_closed_bin(value, edges)).where(F.col("bin").isNotNull())
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(target).alias("rate"))


def rate_by_clipped(df: DataFrame, value: str, cap: int, target: str = "target") -> DataFrame:
    v = F.least(F.col(value), F.lit(cap)).alias("value")
    return df.groupBy(v).agg(F.count("*").alias("n"), F.avg(target).alias("rate"))


def mode_per_group(df: DataFrame, by: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Most frequent value; ties go to the smallest.

    Counts first, so a hot group is a list of its distinct values, reduced
    before the shuffle, and never one buffer of raw rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(out or value))


def with_min_support(df: DataFrame, by: Sequence[str], p: str, minimum: int = 50) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_risk"), F.max(p).alias("max_risk")
    ).where(F.col("n") >= minimum)


def area_rollup(df: DataFrame, by: Sequence[str], p: str = "p", decile: str = "decile", x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        round_half_even(F.avg(p), 5).alias("mean_risk"),
        round_half_even(F.max(p), 5).alias("max_risk"),
        round_half_even(100 * F.avg((F.col(decile) == 10).cast("double")), 2).alias("pct_decile_10"),
        round_half_even(F.avg(x), 6).alias("lon"),
        round_half_even(F.avg(y), 6).alias("lat"),
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n_with_coordinates"),
    )


def group_quantile_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median and 90th percentile per group."""
    means = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return means.join(exact_quantiles(df, value, {"median": 0.5, "p90": 0.9}, by), list(by))


def five_numbers(df: DataFrame, value: str) -> DataFrame:
    """min, quartiles, max, mean, n in one row."""
    q = exact_quantiles(df, value, {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0})
    return with_row(q, df.agg(F.avg(value).alias("mean"), F.count(value).alias("n")))


def composition(df: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """(by..., category, share) of every category that occurs; shares of a group add up to one."""
    counts = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    return counts.join(totals, list(by)).select(*by, category, (F.col("_n") / F.col("_total")).alias("share"))


def wide_composition(shares: DataFrame, by: Sequence[str], category: str, prefix: str = "mix_") -> DataFrame:
    """Pivot of ``composition``: one column per category found in the data, 0 where a group has none."""
    named = shares.withColumn("_c", F.concat(F.lit(prefix), F.lower(F.col(category))))
    out = named.groupBy(*by).pivot("_c").agg(F.first("share"))
    return out.fillna(0.0, [c for c in out.columns if c not in by])


def count_pivot(df: DataFrame, by: Sequence[str], category: str, values: Sequence[str]) -> DataFrame:
    """Long to wide: one count column per listed category."""
    return df.groupBy(*by).pivot(category, list(values)).agg(F.count(F.lit(1))).fillna(0, subset=list(values))


def rate_pivot(df: DataFrame, sector: str, area: str, areas: Sequence[str], target: str = "target", top: int = 8) -> DataFrame:
    """Mean target of the ``top`` sectors (rows) by area (columns)."""
    sizes = df.where(F.col(sector).isNotNull()).groupBy(sector).agg(F.count("*").alias("_n"))
    best = sizes.orderBy(F.desc("_n"), sector).limit(top).select(sector)
    return df.join(F.broadcast(best), sector, "left_semi").groupBy(sector).pivot(area, list(areas)).avg(target)


def area_features(df: DataFrame, by: Sequence[str], flag: str = "open") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_listed"),
        F.count_if(flag).alias("n_open"),
    ).withColumn("share_closed", 1 - F.col("n_open") / F.col("n_listed"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long crosstab; pivot it with ``count_pivot`` when the values are known."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("n_equal"), F.corr(a, b).alias("r")
    )


def concentration(df: DataFrame, category: str, by: Sequence[str] = ()) -> DataFrame:
    """Categories by size with their cumulative share, overall or within groups.

    Running sums in two levels, inside the slices of one sort and over the
    slices' totals, so any number of categories will do.
    """
    g = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.col(category)]
    placed = sliced(g.withColumn("_one", F.lit(1).cast("long")), order)
    r = running(placed, order, {"_before": "n", "_rank": "_one"}, by)
    if by:
        r = r.join(placed.groupBy(*by).agg(F.sum("n").alias("_total")), list(by))
    else:
        r = r.withColumn("_total", placed.agg(F.sum("n")).scalar())
    return r.select(*by, category, "n", (F.col("_rank") + 1).cast("int").alias("rank"), ((F.col("_before") + F.col("n")) / F.col("_total")).alias("cum_share"))


def top_share(df: DataFrame, category: str, k: int) -> DataFrame:
    c = concentration(df, category)
    return c.where(F.col("rank") <= k).agg(F.max("rank").alias("k"), F.max("cum_share").alias("share"))


def long_tail(df: DataFrame, category: str, share: float = 0.01, small: int = 20) -> DataFrame:
    g = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return g.agg(
        F.count("*").alias("n_categories"),
        F.count_if(F.col("n") / total >= share).alias("n_common"),
        F.count_if(F.col("n") <= small).alias("n_tail"),
    )


def cardinalities(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; exact counts pre-aggregate per column."""
    parts = None
    for c in columns:
        n = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
        one = df.agg(F.lit(c).alias("column"), n.alias("n_distinct"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def class_balance(df: DataFrame, target: str = "target") -> DataFrame:
    hits = F.sum(F.col(target).cast("long"))
    return df.agg(
        F.count("*").alias("n"), hits.alias("hits"), F.avg(F.col(target).cast("double")).alias("rate"),
        F.try_divide(F.count("*") - hits, hits).alias("imbalance"),
    )


def yearly_volume(df: DataFrame, year: str, flag: str) -> DataFrame:
    return df.groupBy(year).agg(
        F.count("*").alias("n"), F.count_if(flag).alias("n_open"), F.avg(F.col(flag).cast("double")).alias("share_open")
    )


def coverage(df: DataFrame, by: str, checks: Mapping[str, Column]) -> DataFrame:
    """Share of rows that satisfy each check, per group."""
    return df.groupBy(by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in checks.items()])


def error_rollup(df: DataFrame, by: str, y: str = "y", p: str = "p") -> DataFrame:
    """Predicted minus observed per area."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(y).alias("observed"), F.avg(p).alias("predicted")
    ).withColumn("error", F.col("predicted") - F.col("observed"))


def pooled_observed_predicted(df: DataFrame, by: str, artefact: str, y: str = "y", p: str = "p") -> DataFrame:
    """Observed and predicted mean per district, without the artefact one."""
    out = error_rollup(df.where(F.upper(F.trim(by)) != artefact.upper()), by, y, p)
    return out.drop("error")


def rare_drawer(train: DataFrame, scored: DataFrame, category: str, max_categories: int, min_frequency: int) -> DataFrame:
    """Categories the encoder folds into the rare drawer and rows affected."""
    freq = train.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    ranked = row_numbers(freq, [F.desc("n"), F.col(category)], "rank")
    ranked = ranked.withColumn("total", ranked.agg(F.count("*")).scalar())
    slots = F.when(F.col("total") > max_categories, max_categories - 1).otherwise(F.col("total"))
    rare = ranked.where((F.col("rank") > slots) | (F.col("n") < min_frequency)).select(category, "n")
    hits = scored.join(rare.select(category, F.lit(1).alias("_rare")), category, "left")
    return hits.agg(
        F.count("_rare").alias("rows_in_drawer"), F.avg(F.coalesce("_rare", F.lit(0)).cast("double")).alias("share_in_drawer")
    ).withColumn("categories_in_drawer", rare.agg(F.count("*")).scalar())


def dispersion(df: DataFrame, p: str, by: Sequence[str], digits: int = 6, shared: int = 11) -> DataFrame:
    """How much a score discriminates: distinct values, spread, CV inside
    groups and the share of rows that share their score with >= 10 others."""
    red = df.withColumn("_p", F.round(p, digits))
    ties = red.groupBy("_p").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_distinct"),
        (F.sum(F.when(F.col("n") >= shared, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_tied"),
    )
    spread_row = df.agg(F.stddev_samp(p).alias("std"))
    quart = exact_quantiles(df, p, {"q1": 0.25, "q3": 0.75})
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(p).alias("m"), F.stddev_samp(p).alias("s")).where("n >= 2")
    cv = F.coalesce(F.try_divide(F.col("s"), F.nullif(F.col("m"), F.lit(0.0))), F.lit(0.0))
    inside = groups.select("n", cv.alias("cv")).agg(
        F.count("*").alias("n_groups"), F.avg("cv").alias("cv_simple"),
        F.try_divide(F.sum(F.col("cv") * F.col("n")), F.sum("n")).alias("cv_weighted"),
    )
    out = ties
    for part in (spread_row, quart, inside):  # one-row frames
        out = with_row(out, part)
    return out.withColumn("iqr", F.col("q3") - F.col("q1")).drop("q1", "q3")


def tie_groups(df: DataFrame, p: str) -> DataFrame:
    """Size of every group of equal scores."""
    return df.groupBy(p).agg(F.count("*").alias("n"))


def wide_to_long(df: DataFrame, key: str, blocks: Mapping[str, Mapping[str, str]], label: str) -> DataFrame:
    """Wide metric columns to one row per (key, block).

    ``blocks``: block name -> {output column: wide column}.
    """
    items = [
        F.struct(F.lit(b).alias(label), *[F.col(src).alias(dst) for dst, src in cols.items()]) for b, cols in blocks.items()
    ]
    return df.select(key, F.explode(F.array(*items)).alias("_b")).select(key, "_b.*")


def long_matches_wide(long: DataFrame, wide: DataFrame, key: str, blocks: Mapping[str, Mapping[str, str]], label: str) -> DataFrame:
    """Mismatches when the long form is pivoted back (must be zero)."""
    values = sorted({dst for cols in blocks.values() for dst in cols})
    back = long.groupBy(key).pivot(label, list(blocks)).agg(*[F.first(v).alias(v) for v in values])
    j = wide.join(back, key, "full")
    bad = F.lit(False)
    for b, cols in blocks.items():
        for dst, src in cols.items():
            name = f"{b}_{dst}" if len(values) > 1 else b
            bad = bad | ~F.col(src).eqNullSafe(F.col(name))
    return j.agg(F.count_if(bad).alias("mismatches"))
