"""Pairs, history, brand and neighbourhood against small plain-Python twins."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.operators import brand, history, neighbourhood, pairs
from panelflow.plans import dataset

WORDS = ["ALFA", "BETA", "GAMMA", "ALFAS", "NO INFORMADO", "", "BAR", "DELTA"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        for year in range(2015, 2021):
            if rng.random() < 0.8:
                label = rng.choice(WORDS) if rng.random() < 0.5 else "FIJO" + str(i)
                rows.append((i, year, label, rng.random() < 0.8, f"d{i % 3}", f"M{i % 4}" if i % 5 == 0 else None, label.lower()))
    return spark.createDataFrame(rows, "id long, anio int, norm string, open boolean, barrio string, mall string, label string").cache()


def same(a, b):
    """Identity for these one-word labels: ALFA and ALFAS are alike."""
    return a == b or {a, b} == {"ALFA", "ALFAS"} or (a.startswith("FIJO") and b.startswith("FIJO") and _near(a, b))


def _near(a, b):
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio() >= 0.82


def known(n):
    return n not in ("NO INFORMADO", "", "BAR")


def test_history_equals_sequential_fold(panel):
    rows = panel.toPandas().sort_values(["id", "anio"])
    expected = {}
    for i, g in rows.groupby("id"):
        first = business = prev = None
        turns = 0
        for year, norm in zip(g["anio"], g["norm"]):
            if first is None:
                first = business = year
            elif known(norm) and known(prev) and norm != prev and not same(prev, norm):
                turns += 1
                business = year
            prev = norm
            expected[(i, year)] = (first, business, turns)
    got = {(r.id, r.anio): (r.first_year, r.business_year, r.turnovers) for r in history.history_as_of(panel).collect()}
    assert got == expected


def test_window_history_is_the_last_state(panel):
    whole = history.history_as_of(panel.where("anio between 2016 and 2018"))
    last = {r.id: (r.first_year, r.business_year, r.turnovers) for r in whole.orderBy("anio").collect()}
    got = {r.id: (r.first_year, r.business_year, r.turnovers) for r in history.history(panel, 2018, 2016).collect()}
    assert got == last


def test_replicated_window_equals_single_window(panel):
    many = history.replicated_history(panel, [2018, 2019], 3)
    for year in (2018, 2019):
        one = {tuple(r) for r in history.history(panel, year, year - 3).collect()}
        got = {tuple(r) for r in many.where(F.col("cohort") == year).drop("cohort").collect()}
        assert got == one


def test_history_never_looks_ahead(panel):
    full = history.history_as_of(panel).where("anio <= 2017")
    cut = history.history_as_of(panel.where("anio <= 2017"))
    assert full.exceptAll(cut).count() == 0 and cut.exceptAll(full).count() == 0


def test_target_parts(panel):
    lab = pairs.label_pairs(panel)
    assert lab.where("(gone or closed or rotated) <> (target = 1)").count() == 0
    assert lab.where("rotated and (not present or not open1 or same)").count() == 0
    assert lab.select("id", "cohort").distinct().count() == lab.count()
    assert lab.where("cohort = 2020").count() == 0


def test_target_against_dictionary(panel):
    rows = {(r.id, r.anio): r for r in panel.collect()}
    expected = {}
    for (i, y), r in rows.items():
        if y == 2020 or not r.open or not known(r.norm):
            continue
        n = rows.get((i, y + 1))
        if n is None or not n.open:
            t = 1
        else:
            t = int(n.norm != "" and n.norm != r.norm and known(n.norm) and not same(r.norm, n.norm))
        expected[(i, y)] = t
    got = {(r.id, r.cohort): r.target for r in pairs.label_pairs(panel).collect()}
    assert got == expected


def test_brand_features(panel):
    got = brand.brand_features(panel).toPandas().set_index(["id", "anio"])
    rows = panel.toPandas()
    rows["key"] = ["" if n == "BAR" else n for n in rows["norm"]]
    for (y, k), g in rows.groupby(["anio", "key"]):
        want = 1 if k == "" else len(g)
        assert (got.loc[list(zip(g["id"], g["anio"])), "same_brand"] == want).all()
    in_mall = rows.set_index(["id", "anio"])["mall"].notna().astype(int).sort_index()
    assert (got["in_mall"].sort_index() == in_mall).all()


def brute(points, radius):
    out = {}
    for a in points:
        near = [b for b in points if b[0] != a[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius**2]
        n = len(near)
        out[a[0]] = (
            n,
            None if n == 0 else 1 - sum(b[4] for b in near) / n,
            None if n == 0 else len({b[3] for b in near}) / n,
            sum(b[3] is not None and b[3] == a[3] for b in near),
            None if n == 0 else sum(b[5] or 0 for b in near) / n,
        )
    return out


@pytest.mark.parametrize("split", [2, 5, None])
@pytest.mark.parametrize("hot", [False, True])
def test_neighbourhood_equals_brute_force(spark, split, hot, monkeypatch):
    """Random points, points exactly on the radius, and a square (and a single
    place) holding a third of all points."""
    if hot:
        monkeypatch.setattr(neighbourhood, "PLACES", 6)  # many levels
    rng = random.Random(11)
    pts = []
    for i in range(240):
        if hot and i % 3 == 0:
            x, y = (5000.0, 5000.0) if i % 2 else (5000 + rng.random() * 30, 5000 + rng.random() * 30)
        elif i % 10 == 0:
            x, y = 5000.0 + 150 * (i % 3), 5000.0 + 150 * (i % 2)
        else:
            x, y = 4700 + rng.random() * 600, 4700 + rng.random() * 600
        pts.append((i, x, y, rng.choice(["p", "q", "r", None]), rng.random() < 0.7, rng.choice([None, 0, 1, 2])))
    df = spark.createDataFrame(pts, "id long, x double, y double, division string, open boolean, t int").withColumn("anio", F.lit(2020))
    got = neighbourhood.neighbourhoods(df, {"_a": 150.0, "_b": 200.0}, weight="t", split=split).collect()
    assert len(got) == len(pts)
    for radius, s in ((150.0, "_a"), (200.0, "_b")):
        want = brute(pts, radius)
        for r in got:
            n, vac, div, comp, turn = want[r.id]
            assert r[f"n{s}"] == n and r[f"competitors{s}"] == comp
            for have, exp in ((r[f"vacancy{s}"], vac), (r[f"diversity{s}"], div), (r[f"turnover{s}"], turn)):
                assert (have is None) == (exp is None)
                assert exp is None or math.isclose(have, exp, abs_tol=1e-9)


def test_hot_square_is_not_paired_with_itself(spark):
    """One square with many places: no pair of its places is compared."""
    df = spark.range(3000).select(
        "id", (F.lit(2000.0) + F.col("id") % 60 * 0.1).alias("x"), (F.lit(2000.0) + F.floor(F.col("id") / 60) * 0.1).alias("y"),
        F.lit("p").alias("division"), F.lit(True).alias("open"), F.lit(1).alias("anio"),
    )
    out = neighbourhood.neighbourhood(df, 150.0)
    assert out.where("n <> 2999").count() == 0


def test_dense_rim_is_quartered_until_few_places_meet(spark, monkeypatch):
    """Two dense patches whose distances straddle the radius: far fewer comparisons than pairs."""
    rng = np.random.default_rng(5)
    a, b = rng.random((900, 2)) * 20 + 1000, rng.random((900, 2)) * 20 + [1145, 1000]
    xy = np.vstack((a, b))
    pdf = pd.DataFrame({"id": range(1800), "anio": 1, "x": xy[:, 0], "y": xy[:, 1], "division": "p", "open": True})
    compared = []
    real = neighbourhood.materialise

    def watched(df, label="cut"):
        out = real(df, label)
        if label == "pairs":
            rim = out.where("o0 AND na * nb <= 1024").agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
            compared.append(rim or 0)
        return out

    monkeypatch.setattr(neighbourhood, "materialise", watched)
    got = neighbourhood.neighbourhood(spark.createDataFrame(pdf), 150.0).select("id", "n").toPandas().set_index("id")["n"].sort_index()
    want = (((xy[:, None] - xy[None]) ** 2).sum(-1) <= 150.0**2).sum(1) - 1
    assert (got.to_numpy() == want).all()
    assert len(compared) > 2 and sum(compared) < 0.35 * 2 * 900 * 900


def test_space_features_need_enough_points(spark):
    df = spark.createDataFrame([(i, 2020, 5000.0 + i, 5000.0, "p", True) for i in range(20)],
                               "id long, anio int, x double, y double, division string, open boolean")
    assert dataset.space_features(df).count() == 0
    assert dataset.space_features(df, minimum=10).count() == 20


@pytest.mark.parametrize("fuzzy", [False, True])
def test_history_by_increments_equals_history_of_all_years(spark, tmp_path, fuzzy):
    rng = random.Random(9)
    names = ["BAR LOLA", "BAR LOLAS", "CASA PEPE", "PANADERIA SOL", "PANADERIA SOLE", "SIN ROTULO", "", None]
    rows = [(i, 2015 + y, rng.choice(names[: 2 + i % 7])) for i in range(120) for y in range(6) if rng.random() < 0.8]
    panel = spark.createDataFrame(rows, "id long, anio int, norm string").repartition(3)
    want = {(r.id, r.anio): (r.first_year, r.business_year, r.turnovers) for r in history.history_as_of(panel, fuzzy=fuzzy).collect()}
    t, got = history.HistoryTable(spark, str(tmp_path / "h"), fuzzy=fuzzy), {}
    for year in range(2015, 2021):
        snapshot = panel.where(F.col("anio") == year)
        t.advance(snapshot, year)
        if year == 2017:
            t.advance(snapshot, year)  # a repeated step
        got |= {(r.id, r.anio): (r.first_year, r.business_year, r.turnovers) for r in t.after(snapshot, year).collect()}
    assert got == want
    stored = spark.read.parquet(str(tmp_path / "h"))
    assert stored.count() < len(rows)  # unchanged ids are not written again
    assert stored.where("part > 2015").count() == sum(
        1 for y in range(2016, 2021) for i, n in {(i, n) for i, a, n in rows if a == y}
        if not (before := [(a, m) for j, a, m in rows if j == i and a < y]) or max(before, key=lambda x: x[0])[1] != n)
    small = t.compact(2018, str(tmp_path / "c"))
    assert sorted(map(str, small.rows().collect())) == sorted(map(str, t.rows().collect()))
    assert [r["part"] for r in spark.read.parquet(str(tmp_path / "c")).select("part").distinct().orderBy("part").collect()] == [2018, 2019, 2020]


def test_expanding_and_previous(spark):
    df = spark.createDataFrame(pd.DataFrame({"b": ["a"] * 4, "y": [1, 2, 4, 5], "v": [1.0, 3.0, 5.0, 7.0]})).withColumn("y", F.col("y").cast("int"))
    out = history.expanding_mean(history.previous_year(df, "b", "y", "v", "prev"), "b", "y", "v", "mean").orderBy("y").collect()
    assert [r.prev for r in out] == [None, 1.0, None, 5.0]
    assert [r["mean"] for r in out] == [None, 1.0, 2.0, 3.0]
