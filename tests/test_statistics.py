"""Ordered aggregates, ranking metrics, bootstrap and drift."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.functions.numbers import wilson
from panelflow.operators import areas, drift, evaluate, ordered, reconcile, resample, rollup
from panelflow.operators.ordered import exact_quantiles


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 600
    p = np.where(np.arange(n) % 3 == 0, 0.25, np.round(rng.random(n), 2))  # a third of all rows share one score
    y = (rng.random(n) < p).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "p": p, "p2": np.round(rng.random(n), 2), "y": y, "g": np.arange(n) % 7})
    return spark.createDataFrame(pdf).cache(), pdf


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_and_symmetry(scored):
    df, pdf = scored
    r = evaluate.ranking_metrics(df).first()
    assert math.isclose(r.auc, auc(pdf["y"].values, pdf["p"].values), abs_tol=1e-12)
    flipped = evaluate.ranking_metrics(df.withColumn("p", -F.col("p"))).first()
    assert math.isclose(r.auc + flipped.auc, 1, abs_tol=1e-12)
    assert math.isclose(r.brier, ((pdf["p"] - pdf["y"]) ** 2).mean(), abs_tol=1e-12)


def test_tie_averaged_lift_is_the_mean_over_orders(scored):
    df, pdf = scored
    got = evaluate.ranking_metrics(df).first().lift
    rng = np.random.default_rng(0)
    lifts = []
    for _ in range(3000):
        o = np.lexsort((rng.random(len(pdf)), -pdf["p"].values))[: len(pdf) // 10]
        lifts.append(pdf["y"].values[o].mean() / pdf["y"].mean())
    assert abs(np.mean(lifts) - got) < 0.02


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int")
    r = evaluate.ranking_metrics(df).first()
    assert r.auc is None and r.average_precision is None and r.lift is None


@pytest.mark.parametrize("n", [1, 2, 7, 10, 11, 23, 100, 101])
def test_rank_buckets_match_quantile_cut(spark, n):
    rng = random.Random(n)
    pdf = pd.DataFrame({"id": range(n), "p": [round(rng.random(), 1) for _ in range(n)]})
    got = ordered.rank_buckets(spark.createDataFrame(pdf), "p", "id").toPandas().sort_values("id")["decile"]
    if n == 1:
        assert list(got) == [1]
        return
    order = pdf.sort_values(["p", "id"]).index
    rank = pd.Series(np.arange(1, n + 1), index=order).sort_index()
    if n > 10:
        want = pd.qcut(rank, 10, labels=range(1, 11)).astype(int)
        assert list(got) == list(want)
    assert sorted(got) == sorted(max(1, math.ceil((r - 1) * 10 / (n - 1))) for r in range(1, n + 1))


def test_row_numbers_with_many_slices(spark):
    df = spark.range(5000, numPartitions=13).withColumn("v", F.col("id") % 3)
    got = ordered.row_numbers(df, ["v", "id"]).toPandas().sort_values("rn")
    assert list(got["rn"]) == list(range(1, 5001))
    assert list(zip(got["v"], got["id"])) == sorted(zip(got["v"], got["id"]))


def test_exact_quantiles(scored):
    df, pdf = scored
    got = ordered.exact_quantiles(df, "p", {"a": 0.1, "b": 0.5, "c": 0.97}, ["g"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["p"].quantile([0.1, 0.5, 0.97]).unstack()
    assert np.allclose(got[["a", "b", "c"]].values, want.values)
    one = ordered.exact_quantiles(df, "p", {"m": 0.5}).first().m
    assert math.isclose(one, pdf["p"].median())


def test_with_row_rejects_two_rows(spark):
    with pytest.raises(Exception):
        ordered.with_row(spark.range(2), spark.range(2).withColumnRenamed("id", "x")).collect()


def test_bootstrap_is_repeatable_and_centred(scored):
    df, pdf = scored
    a = resample.bootstrap(df, replicates=200, seed=4).first()
    b = resample.bootstrap(df.repartition(5), replicates=200, seed=4).first()
    assert a.asDict() == pytest.approx(b.asDict())
    point = evaluate.ranking_metrics(df).first()
    assert a.auc_lo < point.auc < a.auc_hi
    assert abs(a.auc_mean - point.auc) < 3 * (a.auc_hi - a.auc_lo) / 4 / math.sqrt(200) + 0.003
    assert a.auc_hi - a.auc_lo < 0.2


def test_paired_difference_of_a_score_with_itself(scored):
    df, _ = scored
    r = resample.paired_differences(df.withColumn("same", F.col("p")), "p", ["same", "p2"], replicates=60).toPandas().set_index("model")
    assert r.loc["same", "d_auc_lo"] == r.loc["same", "d_auc_hi"] == 0
    assert r.loc["p2", "d_auc_hi"] < 0


def _weighted(p, y, w, q=0.1):
    """AUC, lift and Brier of weighted rows, by comparing all pairs."""
    pos, neg = w * y, w * (1 - y)
    auc = (pos[:, None] * neg[None, :] * ((p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :]))).sum() / (pos.sum() * neg.sum())
    left, hits = max(1, math.floor(w.sum() * q)), 0.0
    cut = left
    for v in sorted(set(p), reverse=True):
        n, k = w[p == v].sum(), pos[p == v].sum()
        if n:
            hits += k * min(left, n) / n
            left -= min(left, n)
    return auc, hits / cut / (pos.sum() / w.sum()), (w * (p - y) ** 2).sum() / w.sum()


@pytest.mark.parametrize("digits,block,partitions", [(1, 1 << 20, 3), (2, 300, 5), (6, 300, 7), (6, 1 << 20, 1)])
def test_replicates_by_slices_equal_all_pairs(spark, monkeypatch, digits, block, partitions):
    monkeypatch.setattr(resample, "CELLS", block)
    rng = np.random.default_rng(digits)
    n, replicates = 230, 12
    p = np.round(rng.random(n), digits)
    pdf = pd.DataFrame({"k": [f"r{i}" for i in range(n)], "y": (rng.random(n) < 0.15 + 0.5 * p).astype(int), "p": p, "p2": np.round(1 - p, 1)})
    df = spark.createDataFrame(pdf).repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        cells = resample._cells(df.select("y", "p", "p2", "k"), ["y", "p", "p2"], "k")
        got = resample._replicate_metrics(cells, ["p", "p2"], replicates, 3).toPandas().set_index(["model", "rep"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    w = resample.draw(np.ones(n), pdf["k"].to_numpy(object), replicates, 3)
    assert len(got) == 2 * replicates and abs(w.mean() - 1) < 0.1
    for (model, rep), r in got.iterrows():
        want = _weighted(pdf[model].to_numpy(), pdf["y"].to_numpy(), w[:, rep])
        assert np.allclose([r.auc, r.lift, r.brier], want, atol=1e-12), (model, rep)
        assert (r.n, r.positives) == (w[:, rep].sum(), (w[:, rep] * pdf["y"]).sum())


def test_replicates_of_cells_with_heavy_ties(spark):
    df = spark.createDataFrame([(0, 0.5)] * 900 + [(1, 0.5)] * 300 + [(1, 0.9)] * 50 + [(0, 0.1)] * 200, "y int, p double").repartition(4)
    cells = resample._cells(df, ["y", "p"], None)
    assert cells.count() == 4
    t = cells.toPandas()
    w = resample.draw(t["_n"].to_numpy(), t["_key"].to_numpy(), 20, 0)
    got = resample._replicate_metrics(cells, ["p"], 20, 0).toPandas().set_index("rep")
    for rep, r in got.iterrows():
        assert np.allclose([r.auc, r.lift, r.brier], _weighted(t["p"].to_numpy(), t["y"].to_numpy(), w[:, rep]), atol=1e-12)
    plan = resample._replicate_metrics(cells, ["p"], 20, 0)._jdf.queryExecution().toString()
    assert "posexplode" not in plan.lower()


def test_poisson_draws_from_digests():
    w = resample.draw(np.ones(4000), np.array([f"k{i}" for i in range(4000)], object), 9, 5)
    assert w.shape == (4000, 9) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert np.array_equal(w[:7], resample.draw(np.ones(7), np.array([f"k{i}" for i in range(7)], object), 12, 5)[:, :9])


def test_group_sums_of_replicates(spark, monkeypatch):
    monkeypatch.setattr(resample, "GROUPS", 3)
    pdf = pd.DataFrame({"k": [f"r{i}" for i in range(90)], "a": [f"g{i % 8}" for i in range(90)], "v": np.arange(90.0)})
    df = spark.createDataFrame(pdf).repartition(3)
    got = resample.replicate_sums(df, {"s": "v", "t": "v * v"}, "a", 6, 1, "k").toPandas().set_index(["a", "rep"])
    w = resample.draw(np.ones(90), pdf["k"].to_numpy(object), 6, 1)
    for (a, rep), r in got.iterrows():
        m = pdf["a"] == a
        assert np.allclose([r.w, r.s, r.t], [w[m, rep].sum(), (w[m, rep] * pdf["v"][m]).sum(), (w[m, rep] * pdf["v"][m] ** 2).sum()])
    assert len(got) == 48


def test_wilson_contains_rate(spark):
    r = spark.createDataFrame([(1, 40), (0, 5), (8, 25)], "k int, n int").select(wilson("k", "n").alias("w")).select("w.*").collect()
    assert all(x.low <= x.rate <= x.high for x in r)
    assert round(r[2].low, 3) == 0.172 and round(r[2].high, 3) == 0.516
    assert spark.createDataFrame([(0, 0)], "k int, n int").select(wilson("k", "n").alias("w")).first().w.rate is None


def test_psi_of_itself_is_zero(scored):
    df, _ = scored
    for bins in (drift.psi_numeric(df, df, "p"), drift.psi_categorical(df, df, "g")):
        assert abs(drift.total_psi(bins, "v").first().psi) < 1e-12


def test_psi_numeric_matches_cut(spark):
    rng = np.random.default_rng(1)
    e, o = rng.integers(0, 40, 500).astype(float), rng.integers(5, 60, 300).astype(float)
    got = drift.total_psi(drift.psi_numeric(
        spark.createDataFrame(pd.DataFrame({"v": e})), spark.createDataFrame(pd.DataFrame({"v": o})), "v"), "v").first().psi
    edges = np.unique(np.quantile(e, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    pe = pd.Series(pd.cut(e, edges)).value_counts(normalize=True, sort=False).clip(lower=1e-4)
    po = pd.Series(pd.cut(o, edges)).value_counts(normalize=True, sort=False).clip(lower=1e-4)
    assert math.isclose(got, ((po - pe) * np.log(po / pe)).sum(), abs_tol=1e-9)
    constant = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert drift.psi_numeric(constant, constant, "v").count() == 0


def test_drift_report_minimum(spark):
    p = spark.createDataFrame([("a", 0.3), ("b", None)], "variable string, psi double")
    assert drift.drift_report(p, 29).first().conclusion == "no conclusion"
    r = drift.drift_report(p, 30).first()
    assert (r.conclusion, r.worst_variable) == ("high drift", "a")


def test_champion_prefers_the_smaller_tied_model(spark):
    c = spark.createDataFrame([("big", 2.0, 9), ("mid", 1.9, 5), ("small", 1.2, 2)], "model string, lift double, n_vars int")
    iv = spark.createDataFrame([("mid", -0.3, 0.1), ("small", -0.9, -0.5)], "model string, d_lift_lo double, d_lift_hi double")
    r = resample.choose_champion(c, iv).first()
    assert (r.leader, r.champion, r.n_tied) == ("big", "mid", 2)


def test_acceptance_rule(spark):
    rows = [(0.1, 0.2, 0.1, 0.0), (-0.1, 0.2, -0.1, 0.5), (-0.1, 0.2, 0.1, 0.5), (-0.1, 0.2, -0.1, 0.3), (-0.3, -0.2, -0.1, 0.9)]
    df = spark.createDataFrame(rows, "d_lift_lo double, d_lift_hi double, d_brier_lo double, cv_weighted double")
    assert [r.verdict for r in resample.acceptance(df).collect()] == ["performance", "utility", "keep", "keep", "keep"]


def test_reference_decile(spark):
    ref = pd.DataFrame({"p": [0.1] * 30 + [0.2] * 10 + list(np.linspace(0.3, 0.9, 60))})
    new = pd.DataFrame({"p": [0.0, 0.1, 0.15, 0.2, 0.25, 0.5, 0.9, 1.0]})
    got = evaluate.reference_decile(spark.createDataFrame(new), spark.createDataFrame(ref), "p").toPandas()["decile"]
    want = [min(int((ref["p"] < v).mean() * 10 + 1e-9) + 1, 10) for v in new["p"]]
    assert list(got) == want


def test_value_quintiles_keep_ties_together(scored):
    df, pdf = scored
    got = evaluate.value_quintiles(df, "p")
    assert got.groupBy("p").agg(F.count_distinct("quintile").alias("k")).where("k > 1").count() == 0


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_by_brackets_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr("panelflow.operators.ordered.ACCURACY", accuracy)
    rng = np.random.default_rng(8)
    n = 6000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.9, 0.0995, 0.0005]), "v": np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(0, 50, n), 1))})
    pdf.loc[pdf.index % 41 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    probs = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p": 0.9, "hi": 1.0}
    v = pdf["v"].dropna()
    assert list(exact_quantiles(df, "v", probs).first()) == pytest.approx(list(np.quantile(v, list(probs.values()))))
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        assert list(r)[1:] == pytest.approx(list(np.quantile(v[pdf["g"] == r.g], list(probs.values()))))
    counted = df.groupBy("v").count()
    assert exact_quantiles(counted, "v", {"m": 0.5}, weight="count").first().m == pytest.approx(np.quantile(v, 0.5))
    assert exact_quantiles(df.limit(0), "v", {"m": 0.5}).collect() in ([], [(None,)])


def test_few_values_are_sorted_for_quantiles(spark):
    df = spark.range(200_000).select((F.xxhash64("id") % 10_000_000 / 7).alias("v"))
    assert ordered._bracketed(df.select(F.col("v").alias("_v")), {"a": 0.25, "b": 0.75}, []).count() < 4000


def test_concentration_over_slices_and_in_groups(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(list("ab"), 5000), "c": [f"c{int(x):04d}" for x in rng.zipf(1.5, 5000) % 900]})
    pdf.loc[::50, "c"] = None
    df = spark.createDataFrame(pdf).repartition(6)
    for by in ([], ["g"]):
        keys = by or [pd.Series(0, pdf.index, name="z")]
        want = {}
        for k, part in pdf.groupby(keys):
            sizes = part["c"].dropna().value_counts().rename_axis("c").reset_index(name="n").sort_values(["n", "c"], ascending=[False, True])
            sizes["share"] = sizes["n"].cumsum() / sizes["n"].sum()
            want |= {(k[0] if by else None, c): (n, r, s) for r, (c, n, s) in enumerate(sizes.itertuples(index=False), 1)}
        out = rollup.concentration(df, "c", by)
        assert "SinglePartition" not in out._jdf.queryExecution().toString().split("== Physical Plan ==")[-1] or not by
        got = {(r["g"] if by else None, r.c): (r.n, r["rank"], r.cum_share) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2]) for k in want)


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "k int, v string")
    assert {r.k: r.v for r in rollup.mode_per_group(df, ["k"], "v").collect()} == {1: "a", 2: "c"}


def test_hull_area(spark):
    rng = random.Random(2)
    square = [("s", float(x), float(y)) for x, y in ((0, 0), (2000, 0), (2000, 1000), (0, 1000))]
    inner = [("s", rng.uniform(0, 2000), rng.uniform(0, 1000)) for _ in range(500)]
    line = [("l", float(i), float(i)) for i in range(5)]
    df = spark.createDataFrame(square + inner + line + [("t", 1.0, 1.0)], "g string, x double, y double").repartition(6)
    assert {r.g: round(r.area_km2, 9) for r in areas.hull_areas(df, "g").collect()} == {"s": 2.0}


def test_reconcile_nulls_and_tolerance(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, 5, 1.0), (3, 5, 1.0)], "k int, n int, r double")
    b = spark.createDataFrame([(1, None, 1.0 + 1e-12), (2, 6, 1.1), (4, 1, 1.0)], "k int, n int, r double")
    got = {r.variable: (r.n, r.n_equal) for r in reconcile.compare(a, b, ["k"], {"n": 0, "r": 1e-9}).collect()}
    assert got == {"n": (2, 1), "r": (2, 1)}
    assert [r.k for r in reconcile.differing_rows(a, b, ["k"], {"n": 0, "r": 1e-9}).collect()] == [2]
    assert {(r.k, r.side) for r in reconcile.one_sided(a, b, ["k"]).collect()} == {(3, "left"), (4, "right")}
