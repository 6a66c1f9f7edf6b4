"""Total order without a single-task window.

``sliced`` range-partitions a frame on its (unique) ordering key and stores
which slice each row is in; ``running`` turns that into exact prefix sums:
a window inside each slice plus the totals of the slices before it.  Equal
values are collapsed by ``value_table`` before the sort, so a value shared by
a third of all rows is one row by the time it is shuffled.  Row-level ranks
sort on (value, id), which range partitioning can split inside a tie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelflow.session import materialise

SLICE = "_slice"
ACCURACY, FEW = 10_000, 1_000


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (totals, cut points, ranges).

    A scalar subquery: it is evaluated once, and more than one row is an error.
    """
    value = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", value).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])


def value_table(df: DataFrame, value: str, sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value) with summed measures (map-side combined)."""
    return df.groupBy(*by, value).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def sliced(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Globally sorted frame with the slice number of every row, stored."""
    return materialise(df.orderBy(*order).withColumn(SLICE, F.spark_partition_id()), "sliced")


def running(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Exclusive prefix sums over a sliced frame.

    ``sums`` maps output name -> summed column.  ``by`` groups must not be null.
    The slice totals hold (#slices x #groups) rows: without groups that is the
    number of partitions, which is why broadcasting them is safe.
    """
    inside = W.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*by).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*by, SLICE).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    offsets = totals.select(
        *by,
        SLICE,
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)
    prefixed = df
    for k, c in sums.items():
        prefixed = prefixed.withColumn(f"_p_{k}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = prefixed.join(offsets, [*by, SLICE])
    for k in sums:
        out = out.withColumn(k, F.col(f"_p_{k}") + F.col(f"_o_{k}")).drop(f"_p_{k}", f"_o_{k}")
    return out


def row_numbers(df: DataFrame, order: Sequence[str | Column], out: str = "rn") -> DataFrame:
    """1-based global position; ``order`` must be a total order."""
    s = sliced(df, order).withColumn("_one", F.lit(1).cast("long"))
    r = running(s, order, {out: "_one"})
    return r.withColumn(out, F.col(out) + 1).drop("_one", SLICE)


def _bracketed(base: DataFrame, probs: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """(by, _v, _n, _kept): value counts in which only values near the wanted quantiles are apart.

    A sketch gives two values around each quantile, twice its rank error and two
    rows of ``FEW`` away; groups with no more rows than that are kept whole.
    All rows outside of these brackets are counted with the end of the bracket
    below them; ``_kept`` counts the rows that really have the value.
    """
    slack = 2.0 / ACCURACY + 2.0 / FEW
    ends = [min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-slack, slack)]
    sketch = base.groupBy(*by).agg(F.percentile_approx("_v", ends, ACCURACY).alias("_q"), F.count("*").alias("_rows"))
    both = base.join(sketch, list(by)) if by else with_row(base, sketch)
    low = [F.get("_q", F.lit(2 * i)) for i in range(len(probs))]
    high = [F.get("_q", F.lit(2 * i + 1)) for i in range(len(probs))]
    inside = (F.col("_rows") <= FEW) | reduce(Column.__or__, [F.col("_v").between(a, b) for a, b in zip(low, high)])
    below = [F.when(b < F.col("_v"), b) for b in high]
    end = F.coalesce(F.greatest(*below) if len(below) > 1 else below[0], F.lit(float("-inf")))
    placed = both.select(*by, F.when(inside, F.col("_v")).otherwise(end).alias("_v"), inside.alias("_in"))
    return placed.groupBy(*by, "_v").agg(F.count("*").alias("_n"), F.count_if("_in").alias("_kept"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group, nulls ignored.

    Reads ``df`` twice: a sketch brackets every quantile, then the values inside
    the brackets are counted one by one and all others in between them; only
    these few values are sorted.  Exact: a row that the sketch put on the wrong
    side stops the run.  ``weight`` is a column of row counts, for tables of
    values that are counted already and read once.
    """
    count = F.col(weight) if weight else F.lit(1).cast("long")
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).try_cast("double").alias("_v"), count.alias("_c")).where("_v IS NOT NULL")
    if weight:
        t = base.groupBy(*by, "_v").agg(F.sum("_c").alias("_n")).withColumn("_kept", F.col("_n"))
    else:
        t = _bracketed(base.drop("_c"), probs, by)
    r = running(sliced(t, ["_v"]), ["_v"], {"_before": "_n"}, by)
    if by:
        r = r.join(r.groupBy(*by).agg(F.sum("_n").alias("_total")), list(by))
    else:
        r = r.withColumn("_total", r.agg(F.sum("_n")).scalar())
    known = F.col("_before") + F.col("_kept")
    first = F.col("_before")
    last = F.col("_before") + F.col("_n")

    def sure(place: Column) -> Column:
        return F.when(place < known, F.col("_v")).otherwise(F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double"))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((first <= lo) & (lo < last), sure(lo))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi < last), sure(hi))).alias(f"_hi_{name}"),
            F.first(pos - lo).alias(f"_fr_{name}"),
        ]
    g = r.groupBy(*by).agg(*aggs)
    return g.select(
        *by,
        *[
            (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_fr_{k}")).alias(k)
            for k in probs
        ],
    )


def cut_points(df: DataFrame, value: str, probs: Sequence[float], weight: str | None = None) -> list[float | None]:
    """Global quantiles as numbers: a handful of cut points, fetched once so
    that later plans carry constants instead of nested subqueries."""
    row = exact_quantiles(df, value, {f"q{i}": p for i, p in enumerate(probs)}, weight=weight).first()
    return [row[f"q{i}"] for i in range(len(probs))]


def rank_buckets(df: DataFrame, score: str, key: str, buckets: int = 10, out: str = "decile") -> DataFrame:
    """Equal-size buckets by (score, key) rank, as a quantile cut of the ranks.

    The cut edges lie at 1 + (n-1)k/buckets and are right-closed, so sizes
    differ from ``ntile``.  Only (score, key) is sorted; the last pair of each
    bucket is read off, and rows are compared with those constants where they
    are.  ``score`` must not be null, ``key`` must be unique.
    """
    pairs = df.select(F.col(score).alias("_s"), F.col(key).alias("_k"))
    r = row_numbers(pairs, ["_s", "_k"], "_rn")
    n = r.agg(F.max("_rn")).first()[0] or 0
    places = sorted({1 + (n - 1) * k // buckets for k in range(1, buckets)}) if n > 1 else []
    ends = [(x["_rn"], x["_s"], x["_k"]) for x in r.where(F.col("_rn").isin(places)).collect()] if places else []  # buckets - 1 rows at most
    at = {rn: (s, k) for rn, s, k in ends}
    bucket = F.lit(1)
    for k in range(1, buckets):
        if n > 1:
            s, i = (F.lit(x) for x in at[1 + (n - 1) * k // buckets])
            bucket = bucket + ((F.col(score) > s) | ((F.col(score) == s) & (F.col(key) > i))).cast("int")
    return df.withColumn(out, bucket)
