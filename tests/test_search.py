"""Adaptive search on a known surface and on a planted signal."""

import math
import random
import threading

from pyspark.sql import functions as F

from panelflow.plans import search
from panelflow.plans.search import Range

SPACE = {"a": Range(1e-3, 10.0, log=True), "b": Range(100, 400, step=50), "c": Range(-1.0, 1.0), "d": Range(3, 12, step=1)}


def surface(p):
    """Greatest, zero, at a = 0.1, b = 250, c = 0.4, d = 5."""
    return -(math.log10(p["a"] / 0.1) ** 2) - ((p["b"] - 250) / 100) ** 2 - 4 * (p["c"] - 0.4) ** 2 - ((p["d"] - 5) / 4) ** 2


def test_ranges_hold_their_values():
    rng = random.Random(0)
    seen = {k: {r.value(rng.random()) for _ in range(2000)} for k, r in SPACE.items()}
    assert seen["b"] == set(range(100, 401, 50)) and seen["d"] == set(range(3, 13))
    assert all(SPACE[k].low <= v <= SPACE[k].high for k in ("a", "c") for v in seen[k])
    assert math.isclose(SPACE["a"].value(0), 1e-3) and math.isclose(SPACE["a"].value(1), 10.0) and SPACE["d"].value(1.0) == 12


def test_adaptive_trials_beat_random_ones_on_a_known_surface():
    adaptive, plain = [], []
    for seed in range(12):
        adaptive.append(max(s for _, s in search.optimise(surface, SPACE, trials=40, seed=seed)))
        rng = random.Random(1000 + seed)
        plain.append(max(surface({k: r.value(rng.random()) for k, r in SPACE.items()}) for _ in range(40)))
    assert sum(adaptive) / 12 > 0.5 * sum(plain) / 12  # both are below zero: half the distance to the top
    assert sum(a > b for a, b in zip(adaptive, plain)) >= 9


def test_trials_are_repeatable_and_run_together():
    most, now, lock, gate = 0, 0, threading.Lock(), threading.Barrier(4, timeout=20)

    def slow(p):
        nonlocal most, now
        with lock:
            now += 1
            most = max(most, now)
        gate.wait()
        with lock:
            now -= 1
        return surface(p)

    a = search.optimise(slow, SPACE, trials=12, together=4, seed=3)
    assert most == 4 and a == search.optimise(surface, SPACE, trials=12, together=4, seed=3)


def test_search_of_a_model(spark):
    df = spark.range(2400).select(
        "id", F.lit(1).alias("cohort"), (F.xxhash64("id") % 10).cast("double").alias("x"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("g"))
    df = df.withColumn("target", ((F.col("x") > 3) != (F.col("g") == "a")).cast("int"))
    space = {"stepSize": Range(0.01, 0.3, log=True), "maxDepth": Range(2, 4, step=1)}
    got = search.adaptive_search(df.where("id < 1600"), df.where("id >= 1600"), ["x"], ["g"], space, trials=4, start=2, together=2, maxIter=3, minInstancesPerNode=5)
    rows = got.collect()
    assert [r.trial for r in rows] == [0, 1, 2, 3] and got.columns == ["trial", "stepSize", "maxDepth", "auc"]
    assert max(r.auc for r in rows) > 0.95  # needs the category as a category
