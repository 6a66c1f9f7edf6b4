"""Bootstrap intervals by Poisson weights.

A replicate gives every row a Poisson(1) weight.  The weights of all replicates
of a row are one array that is drawn where the row is and never stored or
shuffled: rows with equal scores and label become a cell whose weights are
Poisson(count), from a generator keyed by the cell; with a ``key`` column each
row draws from MD5 digests of its key, which any engine can repeat.  Every run
and every retried task gives the same weights.  Against a multinomial bootstrap
the replicate size varies by O(1/sqrt(n)), which the ratios cancel.

Ranking metrics need one global sort by score.  Each slice of it adds up its
weights, and the pairs inside it, for all replicates at once; a value that ends
a slice is kept apart, because it may go on in the next one.  What is shuffled
then is slices x replicates.  Only the lift looks at rows again: those of the
few slices in which the top share of some replicate ends.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators.evaluate import spearman_of_areas
from panelflow.operators.ordered import SLICE, sliced, with_row
from panelflow.session import materialise

MIN_POSITIVES = 10  # fixed value: replicates with fewer positives are skipped
#: Weights held at once in a task.
CELLS = 1 << 20
#: Groups whose sums a task holds before it passes them on.
GROUPS = 256


def poisson_steps() -> list[int]:
    """32-bit numbers from which on a Poisson(1) draw is 1, 2, 3, ...: the distribution function times 2**32."""
    out, below = [], 0.0
    for k in range(13):
        below += math.exp(-1) / math.factorial(k)
        out.append(min(math.ceil(below * 2**32), 2**32))
    return out


_STEPS = np.array(poisson_steps(), np.uint64)


def draw(count: np.ndarray, key: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Weights (rows x replicates): by cell for integer keys, by MD5 for text keys (four replicates a digest)."""
    if key.dtype.kind in "iu":
        mask = (1 << 64) - 1
        rows = [np.random.Generator(np.random.Philox(key=[int(k) & mask, seed & mask])).poisson(float(c), replicates) for c, k in zip(count, key)]
        return np.array(rows, np.int64).reshape(len(count), replicates)
    blocks = -(-replicates // 4)
    digests = b"".join(hashlib.md5(f"{seed}-{k}-{b}".encode()).digest() for k in key for b in range(blocks))
    u = np.frombuffer(digests, ">u4").astype(np.uint64).reshape(len(key), 4 * blocks)[:, :replicates]
    return np.searchsorted(_STEPS, u, side="right").astype(np.int64)


def _cells(df: DataFrame, columns: Sequence[str], key: str | None) -> DataFrame:
    """``columns``, ``_n`` rows and ``_key``: cells of equal rows, or the rows themselves by their key."""
    if key is not None:
        return df.select(*columns, F.lit(1).cast("long").alias("_n"), F.col(key).cast("string").alias("_key"))
    cells = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    return cells.withColumn("_key", F.xxhash64(*columns))


def replicate_sums(df: DataFrame, measures: dict[str, str], by: str | None, replicates: int, seed: int, key: str | None = None) -> DataFrame:
    """(by, rep, w, measures...): weighted sums of SQL expressions per replicate (and group).

    Every task adds up its rows for all replicates; its sums are merged in an aggregate.
    """
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    exprs = [F.expr(e).cast("double").alias(f"m{i}") for i, e in enumerate(measures.values())]
    cells = _cells(df.select(group.alias("g"), *exprs, *([F.col(key)] if key else [])), ["g", *[f"m{i}" for i in range(len(measures))]], key)
    width = len(measures) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            flat = [pa.array([list(v[i]) for v in sums.values()], pa.list_(pa.float64())) for i in range(width)]
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *flat], names=["g", *[f"s{i}" for i in range(width)]])

        for batch in batches:
            t = batch.to_pandas()
            values = np.column_stack([np.ones(len(t)), *(t[f"m{i}"].to_numpy(float) for i in range(width - 1))])
            step = max(1, CELLS // replicates)
            for a in range(0, len(t), step):
                w = draw(t["_n"].to_numpy()[a : a + step], t["_key"].to_numpy()[a : a + step], replicates, seed)
                part = t["g"].iloc[a : a + step]
                for g, at in part.groupby(part, dropna=False, sort=False).indices.items():
                    g = None if pd.isna(g) else g
                    more = values[a : a + step][at].T @ w[at]
                    sums[g] = sums[g] + more if g in sums else more
                    if len(sums) > GROUPS:
                        yield out()
                        sums = {}
        if sums:
            yield out()

    fields = ", ".join(f"s{i} array<double>" for i in range(width))
    parts = cells.select("g", *[f"m{i}" for i in range(width - 1)], "_n", "_key").mapInArrow(add, f"g string, {fields}")
    reps = parts.select("g", F.posexplode(F.arrays_zip(*[f"s{i}" for i in range(width)])).alias("rep", "s"))
    names = ["w", *measures]
    total = reps.groupBy("g", "rep").agg(*[F.sum(f"s.s{i}").alias(n) for i, n in enumerate(names)])
    return total.withColumnRenamed("g", by) if by else total.drop("g")


def _by_value(t: pd.DataFrame, replicates: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values, weights, positive weights) of sorted rows, in blocks of distinct values x replicates; every value comes once."""
    p, y = t["p"].to_numpy(), t["y"].to_numpy()
    step = max(1, CELLS // replicates)
    held = None  # the last value of a block may go on in the next
    for a in range(0, len(t), step):
        w = draw(t["_n"].to_numpy()[a : a + step], t["_key"].to_numpy()[a : a + step], replicates, seed)
        part = p[a : a + step]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        values, n, pos = part[first], np.add.reduceat(w, first), np.add.reduceat(w * y[a : a + step, None], first)
        if held is not None:
            if held[0] == values[0]:
                n[0] += held[1]
                pos[0] += held[2]
            else:
                values, n, pos = np.append(held[0], values), np.vstack((held[1], n)), np.vstack((held[2], pos))
        if len(values) > 1:
            yield values[:-1], n[:-1], pos[:-1]
        held = values[-1], n[-1], pos[-1]
    if held is not None:
        yield np.array([held[0]]), held[1][None], held[2][None]


class _Segments:
    """Sums over a stretch of sorted values: merged ones in the middle, the value at either end apart."""

    def __init__(self) -> None:
        self.rows: list[list] = []  # [low, high, single, n, pos, cross, brier]

    def add(self, low, high, single, n, pos, cross, brier) -> None:
        last = self.rows[-1] if self.rows else None
        if last and last[2] and single and last[0] == low:  # the value went on
            last[3], last[4], last[6] = last[3] + n, last[4] + pos, last[6] + brier
        elif last and not last[2] and not single:
            last[5] = last[5] + cross + pos * (last[3] - last[4])
            last[1], last[3], last[4], last[6] = high, last[3] + n, last[4] + pos, last[6] + brier
        else:
            self.rows.append([low, high, single, n, pos, cross, brier])

    def close(self) -> list[list]:
        """Pairs inside single values count half."""
        return [[*r[:5], r[4] * (r[3] - r[4]) / 2 if r[2] else r[5], r[6]] for r in self.rows]


def _slice_segments(t: pd.DataFrame, replicates: int, seed: int) -> list[list]:
    """Segments of one slice: its first value, all between, its last value."""
    t = t.sort_values("p", kind="stable")
    low, high = t["p"].iloc[0], t["p"].iloc[-1]
    out = _Segments()
    for p, n, pos in _by_value(t, replicates, seed):
        brier = (pos * (1 - p[:, None]) ** 2 + (n - pos) * p[:, None] ** 2).astype(float)
        inner = (p != low) & (p != high)
        ends = np.flatnonzero(~inner)
        if len(ends) and p[ends[0]] == low:
            out.add(low, low, True, n[ends[0]], pos[ends[0]], 0.0, brier[ends[0]])
        if inner.any():
            k, j = n[inner].astype(float), pos[inner].astype(float)
            below = np.cumsum(k - j, axis=0) - (k - j)
            out.add(p[inner][0], p[inner][-1], False, k.sum(0), j.sum(0), (j * (below + (k - j) / 2)).sum(0), brier[inner].sum(0))
        if len(ends) and high != low and p[ends[-1]] == high:
            out.add(high, high, True, n[ends[-1]], pos[ends[-1]], 0.0, brier[ends[-1]])
    return out.rows


_PART = "model int, {slice} int, seg int, low double, high double, single boolean, n array<double>, pos array<double>, crossed array<double>, brier array<double>"
_REPS = "model int, reps array<int>, n array<double>, positives array<double>, auc array<double>, brier array<double>, cut array<double>, top array<double>, {slice} int"


def _merge_model(model: int, t: pd.DataFrame, q: float) -> pd.DataFrame:
    """Replicates of one model from the segments of all slices; those whose top share ends inside a segment name its slice."""
    t = t.sort_values([SLICE, "seg"])
    merged, owner = _Segments(), []
    for r, s in zip(t.drop(columns=SLICE).itertuples(index=False), t[SLICE]):
        merged.add(r.low, r.high, r.single, *(np.asarray(x, float) for x in (r.n, r.pos, r.crossed, r.brier)))
        if len(merged.rows) > len(owner):
            owner.append(s)
    rows = merged.close()
    n, pos = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    total, hits = n.sum(0), pos.sum(0)
    below = np.cumsum(n - pos, axis=0) - (n - pos)
    crossed = sum(np.asarray(r[5], float) for r in rows) + (pos * below).sum(0)
    cut = np.maximum(1, np.floor(total * q))
    above, hits_above = total - np.cumsum(n, axis=0), hits - np.cumsum(pos, axis=0)
    at = (above < cut).argmax(axis=0)  # the segment in which the top share ends
    reps = np.arange(len(total))
    need = cut - above[at, reps]
    single = np.array([r[2] for r in rows])[at]
    with np.errstate(all="ignore"):
        inside = np.where(single, pos[at, reps] * np.minimum(need, n[at, reps]) / n[at, reps], 0.0)
        auc = crossed / (hits * (total - hits))
    top = hits_above[at, reps] + np.nan_to_num(inside)
    where = np.where(single, -1, np.array(owner)[at])
    brier = sum(np.asarray(r[6], float) for r in rows) / np.maximum(total, 1)
    out = []
    for s in np.unique(where):
        m = where == s
        # for unfinished replicates ``cut`` is what is still to be taken inside the slice
        out.append((model, reps[m], total[m], hits[m], auc[m], brier[m], np.where(single, cut, need)[m], top[m], s))
    return pd.DataFrame(out, columns=["model", "reps", "n", "positives", "auc", "brier", "cut", "top", SLICE])


def _replicate_metrics(cells: DataFrame, scores: Sequence[str], replicates: int, seed: int, q: float = 0.10) -> DataFrame:
    """(rep, model, n, positives, auc, brier, lift) of every score column; ``cells``: y, scores, _n, _key."""
    models = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.col(s).cast("double").alias("p")) for i, s in enumerate(scores)]))
    long = cells.select(F.col("y").cast("long").alias("y"), "_n", "_key", models.alias("m")).select("m.model", "m.p", "y", "_n", "_key")
    placed = sliced(long, ["model", "p", "_key", "y"])

    def part(group, t: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(group[0]), int(group[1]), i, *r[:3], *(np.broadcast_to(np.asarray(x, float), (replicates,)) for x in r[3:]))
                for i, r in enumerate(_slice_segments(t, replicates, seed))]
        return pd.DataFrame(rows, columns=["model", SLICE, "seg", "low", "high", "single", "n", "pos", "crossed", "brier"])

    def merge(group, t: pd.DataFrame) -> pd.DataFrame:
        return _merge_model(int(group[0]), t, q)

    def finish(group, t: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
        if not len(open_):
            return pd.DataFrame(columns=["model", "rep", "more"])
        low, high = t["p"].min(), t["p"].max()
        t = t[(t["p"] != low) & (t["p"] != high)].sort_values("p", ascending=False, kind="stable")
        reps = np.concatenate(open_["reps"].to_list())
        left, taken = np.concatenate(open_["cut"].to_list()), np.zeros(len(reps))
        for _, n, pos in _by_value(t, replicates, seed):
            n, pos = n[:, reps].astype(float), pos[:, reps].astype(float)
            ends = np.minimum(np.cumsum(n, axis=0), left)
            inside = np.diff(ends, axis=0, prepend=np.zeros((1, len(reps))))
            with np.errstate(all="ignore"):
                taken = taken + np.nan_to_num(pos * inside / n).sum(0)
            left = left - ends[-1]
        return pd.DataFrame({"model": int(group[0]), "rep": reps, "more": taken})

    parts = placed.groupBy("model", SLICE).applyInPandas(part, _PART.format(slice=SLICE))
    merged = materialise(parts.groupBy("model").applyInPandas(merge, _REPS.format(slice=SLICE)), "replicates")
    open_ = merged.where(F.col(SLICE) >= 0)
    mine = placed.join(F.broadcast(open_.select("model", SLICE)), ["model", SLICE], "left_semi")
    more = mine.groupBy("model", SLICE).cogroup(open_.groupBy("model", SLICE)).applyInPandas(finish, "model int, rep int, more double")
    fields = ["reps", "n", "positives", "auc", "brier", "top"]
    flat = merged.select("model", F.explode(F.arrays_zip(*fields)).alias("r")).select("model", F.col("r.reps").alias("rep"), *[f"r.{f}" for f in fields[1:]])
    flat = flat.join(more, ["model", "rep"], "left")
    hits = F.col("top") + F.coalesce("more", F.lit(0.0))
    cut = F.greatest(F.lit(1.0), F.floor(F.col("n") * q))
    names = F.array(*[F.lit(s) for s in scores])
    out = flat.select(
        "rep", F.get(names, F.col("model")).alias("model"), F.col("n").cast("long").alias("n"), F.col("positives").cast("long").alias("positives"),
        F.when(~F.isnan("auc"), F.col("auc")).alias("auc"), "brier", F.try_divide(hits / cut, F.try_divide(F.col("positives"), F.col("n"))).alias("lift"))
    return out.where(F.col("positives") >= MIN_POSITIVES)


def _interval(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """2.5 and 97.5 percentiles over the replicates (a few hundred rows)."""
    aggs = [F.count("*").alias("replicates")]
    for c in columns:
        aggs += [F.percentile(c, 0.025).alias(f"{c}_lo"), F.percentile(c, 0.975).alias(f"{c}_hi"), F.avg(c).alias(f"{c}_mean")]
    return df.groupBy(*by).agg(*aggs)


def bootstrap(df: DataFrame, y: str = "y", p: str = "p", replicates: int = 500, seed: int = 0, key: str | None = None) -> DataFrame:
    """Intervals of AUC, lift and Brier of one score."""
    src = df.select(F.col(y).alias("y"), F.col(p).alias("p1"), *([F.col(key).alias("_id")] if key else []))
    cells = _cells(src, ["y", "p1"], "_id" if key else None)
    return _interval(_replicate_metrics(cells, ["p1"], replicates, seed), ["auc", "lift", "brier"])


def paired_differences(df: DataFrame, base: str, others: Sequence[str], y: str = "y", replicates: int = 500,
                       seed: int = 0, key: str | None = None) -> DataFrame:
    """Intervals of metric(other) - metric(base) on the same replicates."""
    names = {base: "s0", **{o: f"s{i}" for i, o in enumerate(others, start=1)}}
    src = df.select(F.col(y).alias("y"), *[F.col(c).alias(s) for c, s in names.items()], *([F.col(key).alias("_id")] if key else []))
    cells = materialise(_cells(src, ["y", *names.values()], "_id" if key else None), "cells")
    m = materialise(_replicate_metrics(cells, list(names.values()), replicates, seed).select("rep", "model", "auc", "lift", "brier"), "metrics")
    first = m.where("model = 's0'").select("rep", *[F.col(c).alias(f"_{c}") for c in ("auc", "lift", "brier")])
    d = m.where("model <> 's0'").join(first, "rep").select(
        "model", *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in ("auc", "lift", "brier")]
    )
    label = F.lit(None)
    for o in others:
        label = F.when(F.col("model") == names[o], o).otherwise(label)
    return _interval(d, ["d_auc", "d_lift", "d_brier"], ["model"]).withColumn("model", label)


def spearman_interval(df: DataFrame, area: str, y: str = "y", p: str = "p", replicates: int = 2000,
                      seed: int = 0, key: str | None = None) -> DataFrame:
    """Stratified bootstrap of the area rank correlation: rows are resampled
    inside their area."""
    src = df.select(F.col(area).alias("area"), F.col(y).alias("y"), F.col(p).alias("p"), *([F.col(key).alias("_id")] if key else []))
    s = replicate_sums(src, {"sy": "y", "sp": "p"}, "area", replicates, seed, "_id" if key else None).where("w > 0")
    # rounded, so that equal means are ties whatever the order of summation
    means = s.select("rep", "area", *[F.round(F.col(c) / F.col("w"), 12).alias(k) for c, k in (("sy", "observed"), ("sp", "predicted"))])
    rho = spearman_of_areas(means, by=["rep"]).where(F.col("rho").isNotNull())
    return _interval(rho, ["rho"])


def regression_interval(df: DataFrame, y: str, p: str, replicates: int = 500, seed: int = 0, key: str | None = None) -> DataFrame:
    """Intervals of MAE and R2: the replicate sums are enough for both."""
    src = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"), *([F.col(key).alias("_id")] if key else []))
    s = replicate_sums(src, {"ae": "abs(y - p)", "se": "(y - p) * (y - p)", "sy": "y", "syy": "y * y"}, None, replicates, seed, "_id" if key else None)
    m = s.where("w > 0").select(
        (F.col("ae") / F.col("w")).alias("mae"),
        (1 - F.try_divide(F.col("se"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("w"))).alias("r2"),
    )
    return _interval(m, ["mae", "r2"])


def paired_verdicts(point: DataFrame, intervals: DataFrame, champion: str) -> DataFrame:
    """Ties / better / worse than the champion from the paired lift interval.

    ``point``: model, lift; ``intervals``: model, d_lift_lo, d_lift_hi.
    """
    base = point.where(F.col("model") == champion).select(F.col("lift").alias("_lift"))
    j = with_row(point.join(intervals, "model"), base)
    d = F.col("lift") - F.col("_lift")
    verdict = (
        F.when((F.col("d_lift_lo") <= 0) & (F.col("d_lift_hi") >= 0), "ties")
        .when(d > 0, "better").otherwise("worse")
    )
    return j.select("model", d.alias("d_lift"), "d_lift_lo", "d_lift_hi", verdict.alias("verdict"))


def choose_champion(candidates: DataFrame, intervals: DataFrame) -> DataFrame:
    """Leader by lift, unless a smaller model is statistically tied with it.

    ``candidates``: model, lift, n_vars; ``intervals``: model, d_lift_lo,
    d_lift_hi of that model against the leader.  One row per candidate model.
    """
    lead = candidates.agg(F.min_by(F.struct("model", "n_vars"), F.struct(-F.col("lift"), F.col("model"))).alias("l"))
    j = with_row(candidates, lead).join(intervals, "model", "left")
    tied = (F.col("model") == F.col("l.model")) | (
        (F.col("n_vars") < F.col("l.n_vars")) & (F.col("d_lift_lo") <= 0) & (F.col("d_lift_hi") >= 0)
    )
    j = j.withColumn("tied", F.coalesce(tied, F.lit(False)))
    best = F.min_by(
        F.col("model"), F.when(F.col("tied"), F.struct(F.col("n_vars"), F.when(F.col("model") == F.col("l.model"), 0).otherwise(1), F.col("model")))
    )
    return j.agg(
        F.first("l.model").alias("leader"), F.count_if("tied").alias("n_tied"), best.alias("champion")
    )


def acceptance(intervals: DataFrame, cv: str = "cv_weighted", cv_threshold: float = 0.35) -> DataFrame:
    """Challenger rule: wins by performance, by utility, or is rejected.

    Needs d_lift_lo, d_lift_hi, d_brier_lo and the CV inside groups.
    """
    performance = F.col("d_lift_lo") > 0
    tie = (F.col("d_lift_lo") <= 0) & (F.col("d_lift_hi") >= 0)
    utility = tie & (F.col(cv) > cv_threshold) & (F.col("d_brier_lo") <= 0)
    return intervals.withColumn(
        "verdict", F.when(performance, "performance").when(utility, "utility").otherwise("keep")
    )


def district_reading(spearman: DataFrame, low: float = 0.20, rho: float = 0.5) -> DataFrame:
    """Reading of the area order: rho with rho_lo."""
    return spearman.withColumn(
        "reading", F.when(F.col("rho_lo") < low, "too noisy").when(F.col("rho") < rho, "weak").otherwise("ok")
    )


def keeps_ordering(intervals: DataFrame) -> DataFrame:
    """A later cohort keeps the ordering when AUC > .5 and lift > 1 for sure."""
    return intervals.withColumn("keeps", ((F.col("auc_lo") > 0.5) & (F.col("lift_lo") > 1.0)).cast("int"))
