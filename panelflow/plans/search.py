"""Adaptive search of model parameters in continuous ranges.

Tree-structured Parzen estimation: finished trials are split into the better
quarter and the rest; each parameter gets a density of either part (a mixture
of kernels around its values and a flat one), and of some draws from the better
density the one with the greatest ratio of densities is tried next.  Trials of
a round run at the same time from a thread pool; those that run count among the
rest, so a round spreads out.

The table is encoded once: a trial only fits an estimator on stored vectors.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators.evaluate import ranking_metrics
from panelflow.plans.models import (
    RareCategories, by_rows, encoded_cells, feature_stages, few_tasks, fit_cells, prepare, training_cells,
)
from panelflow.session import materialise

GOOD = 0.25
DRAWS = 24


class Range(NamedTuple):
    """Values from ``low`` to ``high``; whole multiples of ``step`` above ``low`` where it is given."""

    low: float
    high: float
    log: bool = False
    step: int | None = None

    def value(self, u: float) -> float:
        """The value at place ``u`` of [0, 1]."""
        if self.log:
            return min(self.high, max(self.low, math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))))
        if self.step:
            places = int((self.high - self.low) // self.step)
            return int(self.low + self.step * min(places, int(u * (places + 1))))
        return self.low + u * (self.high - self.low)


class _Density:
    """Mixture of kernels around places in [0, 1], cut at its ends, and a flat part."""

    def __init__(self, places: Sequence[float]) -> None:
        self.places = sorted(places)
        ends = [0.0, *self.places, 1.0]
        narrow = 1 / (1 + len(self.places))
        self.widths = [min(1.0, max(b - a, c - b, narrow)) for a, b, c in zip(ends, ends[1:], ends[2:])]

    def draw(self, rng: random.Random) -> float:
        k = rng.randrange(len(self.places) + 1)
        if k == len(self.places):
            return rng.random()
        while not 0 <= (u := rng.gauss(self.places[k], self.widths[k])) <= 1:
            pass
        return u

    def at(self, u: float) -> float:
        total = 1.0
        for m, s in zip(self.places, self.widths):
            inside = (math.erf((1 - m) / s / math.sqrt(2)) - math.erf(-m / s / math.sqrt(2))) / 2
            total += math.exp(-(((u - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi) * inside)
        return total / (1 + len(self.places))


def propose(done: Sequence[tuple[Sequence[float], float]], running: Sequence[Sequence[float]], n: int, rng: random.Random, start: int) -> list[float]:
    """Place in the unit cube to try next, given finished (place, score) and running places."""
    if len(done) < start:
        return [rng.random() for _ in range(n)]
    ranked = sorted(done, key=lambda t: -t[1])
    k = max(1, math.ceil(GOOD * len(ranked)))
    good, rest = [p for p, _ in ranked[:k]], [*(p for p, _ in ranked[k:]), *running]
    out = []
    for i in range(n):
        better, other = _Density([p[i] for p in good]), _Density([p[i] for p in rest])
        out.append(max((better.draw(rng) for _ in range(DRAWS)), key=lambda u: better.at(u) / other.at(u)))
    return out


def optimise(objective: Callable[[dict], float], space: Mapping[str, Range], trials: int = 30, start: int = 8, together: int = 4,
             seed: int = 42) -> list[tuple[dict, float]]:
    """(parameters, score) of every trial, in order; greater scores are better."""
    rng = random.Random(seed)
    done: list[tuple[list[float], float]] = []
    out: list[tuple[dict, float]] = []
    with ThreadPool(together) as pool:
        while len(done) < trials:
            running: list[list[float]] = []
            for _ in range(min(together, trials - len(done))):
                running.append(propose(done, running, len(space), rng, start))
            params = [{name: r.value(u) for (name, r), u in zip(space.items(), place)} for place in running]
            for place, chosen, score in zip(running, params, pool.map(objective, params)):
                done.append((place, score))
                out.append((chosen, score))
    return out


def encoded_once(train: DataFrame, validation: DataFrame, numeric: Sequence[str], categorical: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(target, held_out, weight, n, cell, features) of both tables as cells, stored, for tree estimators."""
    encoder = RareCategories(categorical).fit(train)
    ready = [encoder.transform(prepare(d, numeric, seed=seed)) for d in (train, validation)]
    stages = Pipeline(stages=feature_stages(numeric, categorical, linear=False)).fit(ready[0])
    a, b = (few_tasks(materialise(encoded_cells(stages, training_cells(d, numeric, categorical)), "encoded")) for d in ready)
    return a, b


def adaptive_search(train: DataFrame, validation: DataFrame, numeric: Sequence[str], categorical: Sequence[str], space: Mapping[str, Range],
                    trials: int = 30, start: int = 8, together: int = 4, seed: int = 42, kind: str = "boosting", **fixed) -> DataFrame:
    """One row per trial: its number, its parameters and the AUC on ``validation``."""
    if by_rows(kind, fixed) or "subsamplingRate" in space:
        raise ValueError("the search fits cells of equal rows, which boosting on a sample of rows cannot use")
    a, b = encoded_once(train, validation, numeric, categorical)
    a = a.persist()  # read by every iteration of every trial

    def auc(params: dict) -> float:
        scored = fit_cells(a, kind, **{**fixed, **params}).transform(b)
        row = ranking_metrics(scored.select("target", "n", F.round(vector_to_array("probability")[1], 6).alias("p")), "target", "p", weight="n").first()
        return row["auc"] if row["auc"] is not None else 0.5

    try:
        found = optimise(auc, space, trials, start, together, seed)
    finally:
        a.unpersist()
    rows = [(i, *(float(p[k]) for k in space), score) for i, (p, score) in enumerate(found)]
    return train.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"{k} double" for k in space) + ", auc double")
