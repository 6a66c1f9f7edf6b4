"""Pipelines on a planted signal: metric bands and invariants."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.operators import evaluate
from panelflow.plans import attribution, models


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    n = 3000
    sector = rng.choice(list("abcdefgh"), n)
    age = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 10, n))
    rate = 0.05 + 0.3 * (sector == "a") + 0.2 * (np.nan_to_num(age, nan=5) < 2)
    pdf = pd.DataFrame({"id": np.arange(n), "cohort": 1, "row_id": [f"r{i}" for i in range(n)], "sector": sector, "age": age, "target": (rng.random(n) < rate).astype(int)})
    df = spark.createDataFrame(pdf).withColumn("age", F.when(~F.isnan("age"), F.col("age")))
    return df.where("id < 1800").cache(), df.where("id between 1800 and 2399").cache(), df.where("id >= 2400").cache()


SMALL = {"maxIter": 8, "maxDepth": 3, "minInstancesPerNode": 20}


@pytest.mark.parametrize("kind,params", [("logistic", {}), ("tree", {"minInstancesPerNode": 20}), ("boosting", SMALL)])
def test_signal_is_found_and_calibration_helps(frames, kind, params):
    train, val, test = frames
    m = models.fit(train, ["age"], ["sector"], kind, **params).calibrate(val)
    s = m.score(test)
    assert s.columns == [*test.columns, "p"] and s.count() == test.count()
    r = evaluate.ranking_metrics(s, "target", "p").first()
    assert r.auc > 0.6
    assert r.brier <= r.base_rate * (1 - r.base_rate) + 0.01
    assert s.where("p < 0 or p > 1").count() == 0


def test_unknown_and_rare_categories(spark, frames):
    train, *_ = frames
    e = models.RareCategories(["sector"], max_categories=4, min_frequency=10).fit(train)
    assert len(e.kept["sector"]) == 3
    rare, kept = e.rare["sector"].first()[0], e.kept["sector"][0]
    df = spark.createDataFrame([(rare,), (kept,), ("?",), (None,)], "sector string")
    got = {r.sector: r.sector_cat for r in e.transform(df).collect()}
    assert got == {rare: models.REST, kept: kept, "?": models.MISSING, None: models.MISSING}


def test_attributions_add_up(frames):
    train, val, test = frames
    m = models.fit(train, ["age"], ["sector"], "boosting", **SMALL)
    rows = test.limit(5)
    got = models.shapley_attribution(m, rows, train, "row_id", permutations=6, sample=6).groupBy("row_id").agg(F.sum("contribution").alias("s")).toPandas()
    bg = train.orderBy(F.xxhash64("row_id", F.lit(0)), "row_id").limit(6)
    base = m.raw(bg).agg(F.avg("raw")).first()[0]
    p = m.raw(rows).select("row_id", "raw").toPandas().merge(got, on="row_id")
    assert np.allclose(p["raw"] - base, p["s"], atol=1e-9)


def test_score_under_any_name_with_calibration(frames):
    train, val, test = frames
    m = models.fit(train, ["age"], ["sector"], "boosting", **SMALL).calibrate(val)
    plain = {r.row_id: r.p for r in m.score(test).collect()}
    for name in ("raw", "p0", "_p", "prediction_"):
        scored = m.score(test, name)
        assert scored.columns == [*test.columns, name]
        assert {r.row_id: r[name] for r in scored.collect()} == plain
    again = m.score(m.score(test, "raw"), "p")
    assert [(r.raw, r.p) for r in again.limit(50).collect()] == [(r.p, r.p) for r in again.limit(50).collect()]
    got = models.shapley_attribution(m, test.limit(4), train, "row_id", permutations=5, sample=5).groupBy("row_id").agg(F.sum("contribution").alias("s")).collect()
    base = m.score(train.orderBy(F.xxhash64("row_id", F.lit(0)), "row_id").limit(5)).agg(F.avg("p")).first()[0]
    assert all(abs(r.s - (plain[r.row_id] - base)) < 1e-9 for r in got) and len(got) == 4


def _by_coalitions(leaves, x, background=None):
    """Shapley values of one row by adding up all coalitions."""
    n = len(x)

    def worth(inside):
        total = 0.0
        for leaf in leaves:
            rows = [x] if background is None else [np.where(np.isin(np.arange(n), list(inside)), x, b) for b in background]
            for row in rows:
                share = leaf.value / len(rows)
                for j, f in enumerate(leaf.features):
                    passes = row[f] in leaf.categories[j] if leaf.categories[j] is not None else leaf.low[j] < row[f] <= leaf.high[j]
                    share *= leaf.share[j] if background is None and f not in inside else float(passes)
                total += share
        return total

    out = []
    for i in range(n):
        others, value = [f for f in range(n) if f != i], 0.0
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for s in itertools.combinations(others, size):
                value += weight * (worth({*s, i}) - worth({*s}))
        out.append(value)
    return worth(set()), out


@pytest.mark.parametrize("kind,params", [("boosting", SMALL), ("tree", {"minInstancesPerNode": 20}), ("forest", {"numTrees": 5, "maxDepth": 4, "minInstancesPerNode": 20})])
def test_tree_attributions_are_shapley_values(frames, kind, params):
    train, val, test = (d.withColumn("size", F.col("id") % 7).withColumn("old", (F.col("age") > 4).cast("int")) for d in frames)
    m = models.fit(train, ["age", "size", "old"], ["sector"], kind, **params).calibrate(val)
    leaves = attribution.leaves_of(m)
    few = test.orderBy("row_id").limit(5)
    x = {r.row_id: np.array(r.x) for r in attribution.encoded(m, few, "row_id").collect()}
    p = {r.row_id: r.raw for r in m.raw(test).collect()}
    order = test.orderBy(F.xxhash64("row_id", F.lit(0)), "row_id").limit(6)
    stand = np.array([r.x for r in attribution.encoded(m, order, "row_id").collect()])
    for background in (None, test):
        got = attribution.tree_attribution(m, test, "row_id", background, sample=6).toPandas()
        assert got.groupby("row_id").size().eq(4).all() and got["row_id"].nunique() == test.count()
        margin = got.groupby("row_id")["contribution"].sum() + got.groupby("row_id")["base"].first()
        raw = 1 / (1 + np.exp(-2 * margin)) if kind == "boosting" else margin
        assert np.allclose(raw, [p[i] for i in raw.index], atol=1e-9)
        for row_id, row in x.items():
            base, values = _by_coalitions(leaves, row, None if background is None else stand)
            mine = got[got["row_id"] == row_id].set_index("variable")
            assert np.allclose(mine["contribution"][[*m.categorical, *m.numeric]], values, atol=1e-9) and np.allclose(mine["base"], base, atol=1e-9)


def test_tree_attribution_of_linear_models_is_refused(frames):
    train, *_ = frames
    with pytest.raises(ValueError, match="trees"):
        attribution.leaves_of(models.fit(train, ["age"], ["sector"], "logistic"))


def test_permutation_importance_finds_the_sector(frames):
    train, _, test = frames
    t = train.withColumn("noise", F.rand(1))
    m = models.fit(t, ["age", "noise"], ["sector"], "boosting", **SMALL)
    r = {x.variable: x.auc_fall for x in models.permutation_importance(m, test.withColumn("noise", F.rand(2)), repeats=1).collect()}
    assert r["sector"] > r["noise"] and r["sector"] > 0.02


def test_regression_baselines(spark):
    df = spark.createDataFrame([("a", 1, 0.1, None, 0.2), ("b", 1, 0.3, 0.4, None)], "b string, cohort int, objective double, churn_previous double, churn_mean double")
    got = models.area_baselines(df, df).orderBy("b").collect()
    assert [(round(r.p_mean, 9), round(r.p_persist, 9)) for r in got] == [(0.2, 0.2), (0.2, 0.4)]


def test_fits_weigh_cells_of_equal_rows(frames, monkeypatch):
    """A tree and a forest grow on far fewer rows than the table has, and the tree is the one of the rows."""
    train, _, test = frames
    seen = []
    grown = models.classifier

    def watched(kind, seed=0, **params):
        out = grown(kind, seed, **params)
        fit = out.fit
        out.fit = lambda d: seen.append(d.count()) or fit(d)
        return out

    by_rows = grown("tree", minInstancesPerNode=20)
    monkeypatch.setattr(models, "classifier", watched)
    m = models.fit(train, ["age"], ["sector"], "tree", minInstancesPerNode=20)
    x = m.encoder.transform(models.prepare(train, ["age"]))
    for stage in m.model.stages[:-1]:
        x = stage.transform(x)
    assert m.model.stages[-1].toDebugString.split("\n")[1:] == by_rows.fit(x).toDebugString.split("\n")[1:]
    forest = models.fit(train, ["age"], ["sector"], "forest", numTrees=6, maxDepth=4, minInstancesPerNode=20)
    assert forest.model.stages[-1].getNumTrees == 6 and len(seen) == 7 and max(seen) <= 8 * 11 * 2 * 2
    assert forest.metrics(test).first() == forest.metrics(test).first()
    assert abs(forest.metrics(test).first().auc - evaluate.ranking_metrics(forest.raw(test, "p"), "target", "p").first().auc) < 1e-12
    assert forest.metrics(test).first().auc > 0.6


def test_draws_of_a_cell_are_those_of_its_rows(spark):
    df = spark.range(400).select("id", F.lit(9.0).alias("n"))
    got = np.array([list(r)[2:] for r in models.with_draws(df, "id", "n", 20, 1.0, 3).collect()])
    assert abs(got.mean() - 9) < 0.2 and abs(got.var() - 9) < 0.6


def test_equal_rows_are_scored_once(frames, monkeypatch):
    train, val, test = frames
    m = models.fit(train, ["age"], ["sector"], "boosting", **SMALL).calibrate(val)
    seen, score = [], m.score
    monkeypatch.setattr(m, "score", lambda d, out="p": seen.append(d.count()) or score(d, out))
    once = {r.row_id: r.p for r in m.score_once(test).collect()}
    assert seen == [test.select("sector", "age").distinct().count()] and seen[0] < test.count() / 4
    assert once == {r.row_id: r.p for r in score(test).collect()}
