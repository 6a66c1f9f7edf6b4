"""Streams against their batch twins, late rows and repeated deliveries."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelflow.plans import models
from panelflow.streaming import monitor

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, activity string, probability double"


def log(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m), a, p) for i, m, a, p in rows], SCHEMA)


def write_files(spark, tmp_path, batches):
    """One file per batch, read in this order (one per trigger)."""
    import os
    import time

    folder = tmp_path / "log"
    folder.mkdir()
    for k, rows in enumerate(batches):
        tmp = tmp_path / f"b{k}"
        log(spark, rows).coalesce(1).write.parquet(str(tmp))
        target = folder / f"{k}.parquet"
        next(tmp.glob("part-*.parquet")).rename(target)
        stamp = time.time() - 1000 + k
        os.utime(target, (stamp, stamp))
    return monitor.read_log_stream(spark, str(folder), log(spark, []).schema, files_per_trigger=1)


BATCHES = [
    [(1, 1, "a", 0.01), (2, 20, "b", 0.05), (3, 59, "a", 0.2)],
    [(4, 70, "a", 0.03), (5, 200, "b", 0.5)],
    [(8, 210, "b", 0.4)],
    [(6, 5, "late", 0.9), (7, 260, "a", 0.02)],
]


def test_window_stream_equals_batch_without_late_rows(spark, tmp_path):
    out = monitor.run_to_table(monitor.window_metrics(write_files(spark, tmp_path, BATCHES), "1 hour", delay="30 minutes"), "w")
    # minute 5 arrives two batches after the watermark reached minute 170
    on_time = log(spark, [r for b in BATCHES for r in b if r[2] != "late"])
    want = monitor.closed_windows(monitor.window_metrics(on_time, "1 hour"), on_time, "ts", 1800)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert out.count() == 2


def test_repeated_delivery_is_dropped(spark, tmp_path):
    s = write_files(spark, tmp_path, [BATCHES[0], BATCHES[0], [(3, 60, "a", 0.2), (9, 61, "a", 0.2)]])
    got = monitor.run_to_table(monitor.deduplicated(s, "id", delay="2 hours"), "d")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 9]


def test_histogram_keeps_empty_bins(spark):
    got = {r.range: r.n for r in monitor.histogram(log(spark, BATCHES[0])).collect()}
    assert got == {"<2%": 1, "2-4%": 0, "4-6%": 1, "6-8%": 0, "8-10%": 0, "10-15%": 0, ">15%": 1}


def test_batches_are_ranked_and_stored_once(spark, tmp_path):
    counts = monitor.window_metrics(write_files(spark, tmp_path, BATCHES), "1 hour", by=("activity",), delay="0 seconds")
    out = monitor.run_each_batch(
        counts.select("window_start", "window_end", "activity", "n"), "t", lambda b, _: monitor.top_per_window(b, "activity"),
        "window_start string, window_end string, activity string, n long")
    first = [r for r in out.collect() if r.window_start == "2024-01-01 00:00:00"]
    assert [(r.activity, r.n) for r in first] == [("a", 2)]


def test_valid_and_rejected_rows(spark):
    df = spark.range(4).withColumn("errors", F.when(F.col("id") < 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    ok, bad = monitor.valid_and_side_output(df)
    assert (ok.count(), bad.count()) == (3, 1)


def test_restart_goes_on_where_the_last_run_ended(spark, tmp_path):
    folder, path, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    schema = "id long, v double"

    def run():
        stream = monitor.read_log_stream(spark, str(folder), spark.createDataFrame([], schema).schema)
        return sorted(r.id for r in monitor.run_to_table(stream, "x", path, state).collect())

    spark.createDataFrame([(1, 0.1)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    assert run() == [1]
    assert run() == [1]  # nothing new: nothing is read again
    spark.createDataFrame([(2, 0.1)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    assert run() == [1, 2]


def test_windowed_drift_as_stream_equals_batch(spark, tmp_path):
    reference = log(spark, [(i, 0, "a" if i % 3 else "b", 0.1) for i in range(60)])
    shares = monitor.reference_shares(reference, "activity")
    counts = monitor.run_complete(monitor.window_bins(write_files(spark, tmp_path, BATCHES), shares, "activity", "1 hour"), "d")
    key = lambda r: r.window_start
    got = sorted(monitor.drift_of_windows(counts, shares).collect(), key=key)
    want = sorted(monitor.window_drift(log(spark, [x for b in BATCHES for x in b]), reference, "activity", "1 hour").collect(), key=key)
    assert [(r.window_start, r.n, round(r.psi, 9), r.verdict) for r in got] == [(r.window_start, r.n, round(r.psi, 9), r.verdict) for r in want]
    assert {r.verdict for r in got} == {"no conclusion"}  # fewer than 30 requests an hour


def test_verdict_when_a_window_closes_late_rows_and_a_restart(spark, tmp_path):
    reference = log(spark, [(i, 0, "a" if i % 3 else "b", 0.1) for i in range(60)])
    shares = monitor.reference_shares(reference, "activity")
    folder, path, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def arrive(rows):
        log(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = monitor.read_log_stream(spark, str(folder), reference.schema, files_per_trigger=1)
        out = monitor.run_to_table(monitor.closing_drift(stream, shares, "activity", "1 hour", "10 minutes"), "x", path, state)
        return {r.window_start: (r.n, r.verdict) for r in out.collect()}

    hour = [(i, i % 60, "a" if i % 3 else "b", 0.1) for i in range(90)]  # the shares of the reference
    other = [(200 + i, 60 + i % 60, "c", 0.1) for i in range(40)]
    arrive(hour)
    assert run() == {}  # the hour may still get rows
    arrive([*other, (300, 131, "a", 0.1)])
    first = run()
    assert first == {"2024-01-01 00:00:00": (90, "stable"), "2024-01-01 01:00:00": (40, "high drift")}
    arrive([(400, 5, "c", 0.1), (401, 200, "a", 0.1)])  # too late for its hour; closes the next one
    assert run() == first | {"2024-01-01 02:00:00": (1, "no conclusion")}


def test_streamed_requests_are_checked_like_batches(spark, tmp_path):
    """Unknown categories reject their request, forms and ranges are those of training, a restart scores new files only."""
    train = spark.range(600).select(
        "id", F.lit(1).alias("cohort"), F.element_at(F.array(*map(F.lit, ("Centro", "Norte", "Sur"))), (F.col("id") % 3 + 1).cast("int")).alias("district"),
        (F.col("id") % 9).cast("double").alias("age"), ((F.col("id") % 3 == 0) & (F.col("id") % 9 < 5)).cast("int").alias("target"))
    model = models.fit(train, ["age"], ["district"], "boosting", maxIter=3, maxDepth=2, minInstancesPerNode=10).calibrate(train)
    profile = models.TrainingProfile.of(train, ["age"], ["district"])
    assert profile.ranges == {"age": (0.0, 8.0)} and profile.categories.count() == 3
    folder, path, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    schema = "id long, district string, age double, errors array<string>"

    def run():
        stream = monitor.read_log_stream(spark, str(folder), spark.createDataFrame([], schema).schema)
        return {r.id: r for r in monitor.run_to_table(models.score_requests(model, stream, profile), "x", path, state).collect()}

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    arrive([(1, " centro ", 3.0, []), (2, "Atlantis", 3.0, []), (3, "SUR", 99.0, []), (4, None, None, []), (5, "Norte", 1.0, ["late"])])
    first = run()
    assert {i: r.errors for i, r in first.items()} == {1: [], 2: ["unknown district"], 3: [], 4: [], 5: ["late"]}
    assert {i for i, r in first.items() if r.p is None} == {2, 5}
    assert (first[1].district, first[3].district, first[3].age, first[3].warnings) == ("Centro", "Sur", 8.0, ["age"])
    arrive([(6, "Norte", -1.0, [])])
    again = run()
    assert {i: r for i, r in again.items() if i < 6} == first and again[6].warnings == ["age"]
    batch = spark.createDataFrame([(1, " centro ", 3.0), (3, "SUR", 99.0), (4, None, None), (6, "Norte", -1.0)], "id long, district string, age double")
    scored = {r.id: r.p for r in models.checked_score(model, batch, profile).collect()}
    assert all(abs(again[i].p - p) < 1e-12 for i, p in scored.items()) and len(scored) == 4
