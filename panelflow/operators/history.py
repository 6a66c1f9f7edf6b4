"""Longitudinal features from the observed rows of each id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelflow.functions.similarity import with_same_business
from panelflow.operators.pairs import informative


def by_id():
    """Rows of one id in year order."""
    return W.partitionBy("id").orderBy("anio")


def changes(panel: DataFrame, vocabulary: Sequence[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Panel rows with ``changed``: the label is another business than at the
    previous *observed* row of the id.

    The window group is one id's yearly rows (the panel is unique on id and
    year), so it is bounded by the number of snapshots.
    """
    p = panel.select("id", "anio", "norm").withColumn("prev", F.lag("norm").over(by_id()))
    # cheap test first: most rows keep their label and need nothing else
    moved = F.col("prev").isNotNull() & (F.col("prev") != F.col("norm"))
    needed = moved & informative("norm", vocabulary) & informative("prev", vocabulary)
    p = p.withColumn("_needed", needed)
    p = with_same_business(p, "prev", "norm", "same", vocabulary, needed=F.col("_needed"), fuzzy=fuzzy)
    return p.withColumn("changed", F.coalesce(F.col("_needed") & ~F.col("same"), F.lit(False))).drop(
        "_needed", "same", "prev"
    )


def history_as_of(panel: DataFrame, vocabulary: Sequence[str] | None = None, fuzzy: bool = True,
                  start: int | None = None) -> DataFrame:
    """State of every id after each of its observed years (from ``start``).

    ``first_year``, ``business_year`` and ``turnovers`` only look back.
    """
    if start is not None:
        panel = panel.where(F.col("anio") >= start)
    upto = by_id().rowsBetween(W.unboundedPreceding, 0)
    return changes(panel, vocabulary, fuzzy).select(
        "id",
        "anio",
        F.min("anio").over(upto).alias("first_year"),
        F.coalesce(
            F.max(F.when(F.col("changed"), F.col("anio"))).over(upto), F.min("anio").over(upto)
        ).alias("business_year"),
        F.sum(F.col("changed").cast("int")).over(upto).alias("turnovers"),
    )


def history(panel: DataFrame, until: int, start: int, vocabulary: Sequence[str] | None = None,
            fuzzy: bool = True) -> DataFrame:
    """State of every id within the window [start, until]."""
    inside = panel.where(F.col("anio").between(start, until))
    return changes(inside, vocabulary, fuzzy).groupBy("id").agg(
        F.min("anio").alias("first_year"),
        F.coalesce(F.max(F.when(F.col("changed"), F.col("anio"))), F.min("anio")).alias("business_year"),
        F.sum(F.col("changed").cast("int")).alias("turnovers"),
    )


def replicated_history(panel: DataFrame, years: list[int], length: int = 3, **kw) -> DataFrame:
    """History of each cohort over a window of fixed length, all at once.

    A row counts for every cohort whose window covers it, so it is exploded at
    most ``length + 1`` times; a change needs the previous observed row to be
    inside the same window.
    """
    marked = changes(panel, **kw).withColumn("_prev_year", F.lag("anio").over(by_id()))
    cohorts = F.array(*[F.lit(y) for y in years])
    exploded = marked.withColumn("cohort", F.explode(cohorts)).where(
        F.col("anio").between(F.col("cohort") - length, F.col("cohort"))
    )
    counted = F.col("changed") & (F.col("_prev_year") >= F.col("cohort") - length)
    return exploded.groupBy("cohort", "id").agg(
        F.min("anio").alias("first_year"),
        F.coalesce(F.max(F.when(counted, F.col("anio"))), F.min("anio")).alias("business_year"),
        F.sum(counted.cast("int")).alias("turnovers"),
    )


def derived_ages(df: DataFrame, cohort: Column, start: Column) -> DataFrame:
    """Ages, turnover rate and left-censoring from the history columns."""
    window = cohort - start
    return df.withColumns(
        {
            "business_age": cohort - F.col("business_year"),
            "premises_age": cohort - F.col("first_year"),
            "previous_turnovers": F.coalesce("turnovers", F.lit(0)),
            "turnover_rate": F.when(window > 0, F.coalesce("turnovers", F.lit(0)) / window),
            "age_censored": (F.coalesce("business_year", start) <= start).cast("int"),
        }
    )


def previous_year(df: DataFrame, by: str, year: str, value: str, out: str) -> DataFrame:
    """Value of the previous calendar year; null when that year is missing."""
    prev = df.select(by, (F.col(year) + 1).cast("int").alias(year), F.col(value).alias(out))
    return df.join(prev, [by, year], "left")


def expanding_mean(df: DataFrame, by: str, year: str, value: str, out: str) -> DataFrame:
    """Mean of all earlier years of the group (group x year table)."""
    w = W.partitionBy(by).orderBy(year).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.avg(value).over(w))


def carry_forward(df: DataFrame, by: str, year: str, value: str, last_year: int, until: int) -> DataFrame:
    """Repeat the value of ``last_year`` for the years after it up to ``until``."""
    if until <= last_year:
        return df
    ahead = df.where(F.col(year) == last_year).withColumn(
        year, F.explode(F.sequence(F.lit(last_year + 1), F.lit(until)))
    )
    return df.unionByName(ahead.select(*df.columns))


def last_known(df: DataFrame, by: str, year: str, value: str, first: int, last: int) -> DataFrame:
    """As-of value of each key for every year of a scaffold."""
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year)
    scaffold = df.select(by).distinct().select(by, years)
    w = W.partitionBy(by).orderBy(year).rowsBetween(W.unboundedPreceding, 0)
    return scaffold.join(df, [by, year], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def year_on_year(df: DataFrame, year: str, value: str, out: str) -> DataFrame:
    """Relative change against the previous row of a one-row-per-year table."""
    w = W.partitionBy(F.lit(1)).orderBy(year)
    return df.withColumn(out, F.try_divide(F.col(value) - F.lag(value).over(w), F.lag(value).over(w)))


@dataclass(frozen=True)
class HistoryTable:
    """State of every id, kept up to date snapshot by snapshot.

    A snapshot adds one part (``part=<year>``) below ``path`` with the rows that
    it changes: new ids and ids with another label.  The state after a year is
    the last row of each id up to it.  A part that is written again replaces
    itself, so a failed step is simply repeated; ``compact`` folds old parts
    into one.  Snapshots come in order of their years.
    """

    spark: SparkSession
    path: str
    vocabulary: Sequence[str] | None = None
    fuzzy: bool = True
    SCHEMA = "id long, norm string, first_year int, business_year int, turnovers long, part int"

    def rows(self, until: int | None = None) -> DataFrame:
        """(id, norm, first_year, business_year, turnovers) after ``until`` (by default: the last snapshot)."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.SCHEMA).drop("part")
        parts = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        if until is not None:
            parts = parts.where(F.col("part") <= until)
        last = F.max_by(F.struct("norm", "first_year", "business_year", "turnovers"), "part")
        return parts.groupBy("id").agg(last.alias("s")).select("id", "s.*")

    def advance(self, snapshot: DataFrame, year: int) -> None:
        """Meet the snapshot (id, norm; unique ids) of ``year`` with the state before it and write what changes."""
        state = self.rows(year - 1).select(
            "id", F.col("norm").alias("prev"), "first_year", "business_year", "turnovers", F.lit(True).alias("_known"))
        j = snapshot.select("id", "norm").join(state, "id", "left")
        j = j.where(F.col("_known").isNull() | ~F.col("norm").eqNullSafe(F.col("prev")))
        moved = F.col("prev").isNotNull() & F.col("norm").isNotNull()
        needed = moved & informative("norm", self.vocabulary) & informative("prev", self.vocabulary)
        j = with_same_business(j.withColumn("_needed", needed), "prev", "norm", "same", self.vocabulary, needed=F.col("_needed"), fuzzy=self.fuzzy)
        new = F.col("_known").isNull()
        changed = F.coalesce(F.col("_needed") & ~F.col("same"), F.lit(False))
        out = j.select(
            F.col("id").cast("long").alias("id"), "norm", F.coalesce("first_year", F.lit(year)).alias("first_year"),
            F.when(new | changed, F.lit(year)).otherwise(F.col("business_year")).alias("business_year"),
            (F.coalesce("turnovers", F.lit(0)) + changed.cast("int")).cast("long").alias("turnovers"),
        )
        out.write.mode("overwrite").parquet(f"{self.path}/part={year}")

    def after(self, snapshot: DataFrame, year: int) -> DataFrame:
        """The state of the ids that the snapshot of ``year`` holds, as ``history_as_of`` gives it."""
        return snapshot.select("id").join(self.rows(year), "id").select("id", F.lit(year).alias("anio"), "first_year", "business_year", "turnovers")

    def compact(self, until: int, path: str) -> HistoryTable:
        """A table at ``path`` with one part for everything up to ``until`` and the later parts as they are."""
        self.rows(until).write.mode("overwrite").parquet(f"{path}/part={until}")
        parts = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        later = parts.where(F.col("part") > until)
        if not later.isEmpty():
            later.write.mode("append").partitionBy("part").parquet(path)
        return HistoryTable(self.spark, path, self.vocabulary, self.fuzzy)
