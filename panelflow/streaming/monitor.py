"""Prediction-log monitoring as Structured Streaming jobs with batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions.numbers import left_closed_bin
from panelflow.operators import drift
from panelflow.operators.ordered import exact_quantiles
from panelflow.session import materialise, scratch_path

# Histogram edges of the returned probability and their names.
HISTOGRAM_EDGES = (0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 1.01)
HISTOGRAM_NAMES = ("<2%", "2-4%", "4-6%", "6-8%", "8-10%", "10-15%", ">15%")


# ------------------------------------------------------------- batch metrics
def operation_summary(log: DataFrame, ts: str = "ts", p: str = "probability") -> DataFrame:
    """Requests, time range and six statistics of the probability (4 places)."""
    q = exact_quantiles(log, p, {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0})
    stats = log.agg(
        F.count("*").alias("n"), F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
        F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("last_ts"), F.round(F.avg(p), 4).alias("mean"),
    )
    from panelflow.operators.ordered import with_row

    out = with_row(stats, q)
    return out.withColumns({c: F.round(c, 4) for c in ("min", "p25", "median", "p75", "max")})


def histogram(log: DataFrame, p: str = "probability") -> DataFrame:
    """Left-closed bins; empty ones are listed with zero."""
    b = log.select(left_closed_bin(p, HISTOGRAM_EDGES).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(v).alias("range")) for k, v in enumerate(HISTOGRAM_NAMES, 1)])
    frame = log.sparkSession.range(1).select(F.explode(names).alias("r")).select("r.*")
    return frame.join(b, "bin", "left").select("bin", "range", F.coalesce("n", F.lit(0)).alias("n"))


def most_consulted(log: DataFrame, column: str, k: int = 5) -> DataFrame:
    v = F.trim(F.col(column).cast("string"))
    return log.where(v.isNotNull() & (v != "")).groupBy(v.alias("value")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "value"
    ).limit(k)


def version_mix(log: DataFrame, column: str = "version") -> DataFrame:
    return log.groupBy(F.col(column).alias("version")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- streams
def read_log_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files of the request log, as they arrive."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def deduplicated(stream: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries; state is kept only as long as rows may be late."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def window_metrics(log: DataFrame, width: str, slide: str | None = None, ts: str = "ts", p: str = "probability",
                   by: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """Count, sum, min, max and histogram per window; same call for stream
    (with a watermark delay) and batch."""
    if delay:
        log = log.withWatermark(ts, delay)
    bins = [F.count_if(left_closed_bin(p, HISTOGRAM_EDGES) == k).alias(f"h{k}") for k in range(1, len(HISTOGRAM_NAMES) + 1)]
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = log.groupBy(w.alias("w"), *by).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"), *bins
    )
    fmt = "yyyy-MM-dd HH:mm:ss"
    return g.select(
        F.date_format("w.start", fmt).alias("window_start"), F.date_format("w.end", fmt).alias("window_end"),
        *by, "n", "mean", "min", "max", *[f"h{k}" for k in range(1, len(HISTOGRAM_NAMES) + 1)],
    )


def closed_windows(metrics: DataFrame, log: DataFrame, ts: str, delay_seconds: int) -> DataFrame:
    """Batch windows a stream with that watermark would have emitted by now."""
    latest = log.agg(F.date_format(F.timestamp_micros(F.unix_micros(F.max(ts)) - delay_seconds * 1_000_000), "yyyy-MM-dd HH:mm:ss")).scalar()
    return metrics.where(F.col("window_end") <= latest)


def top_per_window(counts: DataFrame, column: str) -> DataFrame:
    """Most consulted value of every window (ties: smallest value)."""
    return counts.groupBy("window_start", "window_end").agg(
        F.min_by(F.struct(column, "n"), F.struct(-F.col("n"), F.col(column))).alias("t")
    ).select("window_start", "window_end", f"t.{column}", "t.n")


def run_to_table(stream: DataFrame, label: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """Process everything available, append to a table and read it back.

    ``path`` and ``state`` (the stream's checkpoint) belong to the caller: the
    same pair makes a restarted driver go on where the last run ended.  Without
    them the run has folders of its own and starts from the beginning.
    """
    spark = stream.sparkSession
    path, state = path or scratch_path(spark, label), state or scratch_path(spark, f"{label}-state")
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_complete(counts: DataFrame, label: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """Run a streaming aggregation over everything available; its result after the last micro-batch.

    Each micro-batch writes the whole result to a folder of its own, so a
    repeated one replaces itself.  ``path`` and ``state`` as in ``run_to_table``.
    """
    spark = counts.sparkSession
    path, state = path or scratch_path(spark, label), state or scratch_path(spark, f"{label}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (
        counts.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    every = spark.read.parquet(path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")


def run_each_batch(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], DataFrame], schema, mode: str = "append",
                   path: str | None = None, state: str | None = None) -> DataFrame:
    """Hand every micro-batch to ``handle`` and store what it returns.

    Each batch writes its own folder, so a repeated batch replaces itself.
    ``path`` and ``state`` as in ``run_to_table``.
    """
    spark = stream.sparkSession
    path, state = path or scratch_path(spark, label), state or scratch_path(spark, f"{label}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(store)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def reference_shares(reference: DataFrame, column: str, top: int = 15) -> DataFrame:
    """(bin, expected) of the reference, at most top + 1 rows, stored: windows and micro-batches reuse them."""
    cats = drift.categories_of(reference, column, top)
    bins = cats.unionByName(reference.sparkSession.range(1).select(F.lit(drift.OTHER).alias("bin")))
    v = reference.select(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("nan")).alias("bin"))
    exp = v.join(F.broadcast(cats.withColumn("_in", F.lit(1))), "bin", "left").groupBy(
        F.when(F.col("_in") == 1, F.col("bin")).otherwise(drift.OTHER).alias("bin")).agg(F.count("*").alias("_e"))
    total = reference.agg(F.count("*")).scalar()
    return materialise(bins.join(exp, "bin", "left").select("bin", F.try_divide(F.coalesce("_e", F.lit(0)), total).alias("expected")), "shares")


def window_bins(log: DataFrame, shares: DataFrame, column: str, width: str, ts: str = "ts") -> DataFrame:
    """(window_start, bin, _o): requests per window and bin; same call for stream and batch."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    v = log.withColumn("bin", F.coalesce(F.trim(F.col(column).cast("string")), F.lit("nan")))
    v = v.join(F.broadcast(shares.select("bin", F.lit(1).alias("_in"))), "bin", "left")
    v = v.withColumn("bin", F.when(F.col("_in") == 1, F.col("bin")).otherwise(drift.OTHER))
    return v.groupBy(F.window(ts, width).alias("_w"), "bin").agg(F.count("*").alias("_o")).select(
        F.date_format(F.col("_w.start"), fmt).alias("window_start"), "bin", "_o")


def drift_of_windows(obs: DataFrame, shares: DataFrame) -> DataFrame:
    """PSI and verdict per window from ``window_bins``; too few requests give no conclusion."""
    totals = obs.groupBy("window_start").agg(F.sum("_o").alias("n"))
    listed = shares.agg(F.collect_list(F.struct("bin", "expected"))).scalar()  # at most top + 1 entries
    frame = totals.withColumn("_l", listed).withColumn("_b", F.explode("_l")).select("window_start", "n", "_b.bin", "_b.expected")
    j = frame.join(obs, ["window_start", "bin"], "left")
    e = F.greatest("expected", F.lit(drift.FLOOR))
    o = F.greatest(F.coalesce("_o", F.lit(0)) / F.col("n"), F.lit(drift.FLOOR))
    out = j.groupBy("window_start").agg(F.first("n").alias("n"), F.sum((o - e) * F.ln(o / e)).alias("psi"))
    return out.withColumn("verdict", F.when(F.col("n") < drift.MIN_REQUESTS, "no conclusion").otherwise(drift.verdict(F.col("psi"))))


def window_drift(log: DataFrame, reference: DataFrame, column: str, width: str, ts: str = "ts", top: int = 15) -> DataFrame:
    """PSI per window against a static reference, all windows in one plan."""
    shares = reference_shares(reference, column, top)
    return drift_of_windows(window_bins(log, shares, column, width, ts), shares)


def closing_drift(log: DataFrame, shares: DataFrame, column: str, width: str, delay: str, ts: str = "ts") -> DataFrame:
    """PSI and verdict of every window, once it is closed (a stream, append mode).

    The watermark keeps one row of counts per open window as state, one count
    per bin of ``shares`` (at most top + 1); a window emits its verdict when no
    more rows can come, and later ones are dropped.
    """
    known = [(r["bin"], r["expected"] or 0.0) for r in shares.collect()]  # top + 1 rows
    names = [b for b, _ in known if b != drift.OTHER]
    value = F.coalesce(F.trim(F.col(column).cast("string")), F.lit("nan"))
    rows = log.select(F.col(ts), F.when(value.isin(names), value).otherwise(drift.OTHER).alias("_bin")).withWatermark(ts, delay)
    counts = [F.count_if(F.col("_bin") == b).alias(f"_o{i}") for i, (b, _) in enumerate(known)]
    g = rows.groupBy(F.window(ts, width).alias("_w")).agg(F.count("*").alias("n"), *counts)
    psi = F.lit(0.0)
    for i, (_, share) in enumerate(known):
        e, o = F.lit(max(share, drift.FLOOR)), F.greatest(F.col(f"_o{i}") / F.col("n"), F.lit(drift.FLOOR))
        psi = psi + (o - e) * F.ln(o / e)
    out = g.select(F.date_format("_w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", psi.alias("psi"))
    return out.withColumn("verdict", F.when(F.col("n") < drift.MIN_REQUESTS, "no conclusion").otherwise(drift.verdict(F.col("psi"))))


def valid_and_side_output(scored: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows to serve and rows to report, from one scored stream or table."""
    bad: Column = F.size(errors) > 0
    return scored.where(~bad), scored.where(bad)
