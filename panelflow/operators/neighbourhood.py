"""Radius neighbourhood of every point without enumerating all pairs.

Points are first collapsed to sites: (snapshot, x, y, category) with
multiplicities.  The plane is cut into squares, ``split`` along the smallest
radius, and a pair of squares is in one of three relations for each radius:

* every point of one is within the radius of every point of the other: the
  squares' *totals* are added, no points meet.  This includes a square with
  itself, so a hot square never goes quadratic;
* no point can be within the radius: skipped;
* on the rim.  If the two hold few places, these are compared one by one
  (squared distance).  If not, both are quartered and their quarters are related
  again: a quadtree that goes down only along the rim and only where it is
  dense, level by level until nothing is open.

So for density d the comparisons grow as d ** 1.5, not d ** 2, no square pair
compares more than ``PLACES`` pairs of places, and nothing depends on a depth
chosen beforehand.  The result is exact for any ``split``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelflow.session import materialise

SPLIT = 2
#: Pairs of places that two squares on the rim compare; beyond it both are quartered.
PLACES = 1024
#: Halvings after which two places that still share a square are compared whatever their number.
DEEPEST = 60


def _relation(dx: Column, dy: Column, radius_in_squares: float) -> tuple[Column, Column]:
    """(wholly inside, on the rim) for two squares (dx, dy) apart and a radius in square sides."""
    far = (F.abs(dx) + 1) * (F.abs(dx) + 1) + (F.abs(dy) + 1) * (F.abs(dy) + 1)
    gap_x, gap_y = F.greatest(F.abs(dx) - 1, F.lit(0)), F.greatest(F.abs(dy) - 1, F.lit(0))
    near = gap_x * gap_x + gap_y * gap_y
    limit = radius_in_squares**2
    # a margin for rounding: doubtful squares are compared point by point
    inside = far < limit * (1 - 1e-9)
    return inside, ~inside & (near <= limit * (1 + 1e-9))


def _related(pairs: DataFrame, radii: Sequence[float], side: float) -> DataFrame:
    """Pairs of squares with marks per radius: ``i`` newly inside, ``o`` open; ``o`` on the way in says where to look."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    marks = {}
    for k, r in enumerate(radii):
        inside, rim = _relation(dx, dy, r / side)
        marks[f"i{k}"] = (F.col(f"o{k}") & inside).alias(f"i{k}")
        marks[f"o{k}"] = (F.col(f"o{k}") & rim).alias(f"o{k}")
    return pairs.select(*[c for c in pairs.columns if c not in marks], *marks.values())


def _any(letter: str, n: int) -> Column:
    return reduce(Column.__or__, [F.col(f"{letter}{k}") for k in range(n)])


def _in_square(df: DataFrame, side: float, x: str, y: str) -> DataFrame:
    return df.withColumn(x, F.floor(F.col("x") / side)).withColumn(y, F.floor(F.col("y") / side))


def _site_neighbours(sites: DataFrame, radii: Sequence[float], side: float, sums: list[str]) -> DataFrame:
    """(snap, x, y, cat) -> measures of that category within each radius.

    ``sites``: snap, x, y, cat + measures, unique on the first four.  Output
    measures are named ``<measure><radius number>``.
    """
    n = len(radii)
    outs = [f"{c}{k}" for k in range(n) for c in sums]
    sites = materialise(sites, "sites")
    places = materialise(sites.select("snap", "x", "y").distinct(), "places")

    def squares(level: int) -> DataFrame:
        return _in_square(places, side / 2**level, "sx", "sy").groupBy("snap", "sx", "sy").agg(F.count("*").alias("k"))

    # pairs of the first level: the squares around each one
    first = materialise(squares(0), "squares")
    reach = math.ceil(max(radii) / side) + 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = first.select("snap", F.col("sx").alias("ax"), F.col("sy").alias("ay"), F.col("k").alias("na"), F.explode(steps).alias("dx"))
    around = around.select("*", F.explode(steps).alias("dy"), *[F.lit(True).alias(f"o{k}") for k in range(n)])
    around = around.select("snap", "ax", "ay", "na", (F.col("ax") + F.col("dx")).alias("bx"), (F.col("ay") + F.col("dy")).alias("by"), *[f"o{k}" for k in range(n)])
    around = _related(around, radii, side).where(_any("i", n) | _any("o", n))
    pairs = around.join(first.select("snap", F.col("sx").alias("bx"), F.col("sy").alias("by"), F.col("k").alias("nb")), ["snap", "bx", "by"])

    found: list[DataFrame] = []
    for level in range(DEEPEST + 1):
        pairs = materialise(pairs, "pairs")
        size = side / 2**level
        # whole squares: totals per (square, category) flow to the squares, and from these to their places
        totals = _in_square(sites, size, "bx", "by").groupBy("snap", "bx", "by", "cat").agg(*[F.sum(c).alias(c) for c in sums])
        flows = pairs.where(_any("i", n)).join(totals, ["snap", "bx", "by"]).groupBy("snap", "ax", "ay", "cat").agg(
            *[F.sum(F.when(F.col(f"i{k}"), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(n) for c in sums])
        here = _in_square(places, size, "ax", "ay")
        found.append(here.join(flows, ["snap", "ax", "ay"]).select("snap", "x", "y", "cat", *outs))
        # rim squares with few places: site against site
        few = (F.col("na") * F.col("nb") <= PLACES) | F.lit(level == DEEPEST)
        there = _in_square(sites, size, "bx", "by").select("snap", "bx", "by", F.col("x").alias("xb"), F.col("y").alias("yb"), "cat", *sums)
        dx, dy = F.col("x") - F.col("xb"), F.col("y") - F.col("yb")
        d2 = dx * dx + dy * dy
        near = here.join(pairs.where(_any("o", n) & few), ["snap", "ax", "ay"]).join(there, ["snap", "bx", "by"]).where(d2 <= max(radii) ** 2)
        found.append(near.groupBy("snap", "x", "y", "cat").agg(
            *[F.sum(F.when(F.col(f"o{k}") & (d2 <= r * r), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, r in enumerate(radii) for c in sums]))
        # the others are quartered
        many = pairs.where(_any("o", n) & ~few)
        if many.isEmpty():
            break
        parts = squares(level + 1)
        half = lambda c: F.floor(F.col(c) / 2)
        left = parts.select("snap", half("sx").alias("ax"), half("sy").alias("ay"), F.col("sx").alias("cx"), F.col("sy").alias("cy"), F.col("k").alias("na"))
        right = parts.select("snap", half("sx").alias("bx"), half("sy").alias("by"), F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("k").alias("nb"))
        open_ = [f"o{k}" for k in range(n)]
        quarters = many.drop("na", "nb").join(left, ["snap", "ax", "ay"]).join(right, ["snap", "bx", "by"]).select(
            "snap", F.col("cx").alias("ax"), F.col("cy").alias("ay"), "na", F.col("ex").alias("bx"), F.col("ey").alias("by"), "nb", *open_)
        pairs = _related(quarters, radii, size / 2).where(_any("i", n) | _any("o", n))
    return reduce(DataFrame.unionByName, found).groupBy("snap", "x", "y", "cat").agg(*[F.sum(c).alias(c) for c in outs])


def neighbourhoods(
    points: DataFrame, radii: Mapping[str, float], snap: str = "anio", key: str = "id", x: str = "x", y: str = "y",
    category: str = "division", flag: str = "open", weight: str | None = None, split: int | None = None,
) -> DataFrame:
    """Neighbourhood aggregates of every point, itself excluded, for several
    radii in one pass (one grid, one join).

    Per radius, with its name appended: ``n`` neighbours, ``vacancy`` (share
    not ``flag``), ``diversity`` (distinct categories / n, null is one more
    category), ``competitors`` (same category; null never matches),
    ``competition`` (competitors / n) and ``turnover`` (mean of ``weight``,
    missing counted as zero).  Ratios are null without neighbours.  ``split``
    squares go along the smallest radius to begin with.
    """
    split = SPLIT if split is None else split
    if split < 2:
        raise ValueError("split must be at least 2")
    w = F.coalesce(F.col(weight), F.lit(0)).cast("double") if weight else F.lit(0.0)
    p = points.select(
        F.col(snap).alias("snap"), F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"),
        # categories are prefixed so that null gets a value of its own
        F.coalesce(F.concat(F.lit("="), F.col(category)), F.lit("")).alias("cat"),
        F.coalesce(F.col(flag).cast("long"), F.lit(0)).alias("f"), w.alias("w"),
    )
    # read by several branches below: store the narrow points once
    p = materialise(p, "points")
    sums = ["n", "f", "w"]
    sites = p.groupBy("snap", "x", "y", "cat").agg(
        F.count("*").alias("n"), F.sum("f").alias("f"), F.sum("w").alias("w")
    )
    around = _site_neighbours(sites, list(radii.values()), min(radii.values()) / split, sums)
    index = range(len(radii))
    # totals over the categories of a place: a window of at most one row per category
    place = W.partitionBy("snap", "x", "y")
    per_site = around.select(
        "snap", "x", "y", "cat",
        *[F.col(f"n{i}").alias(f"n{i}_cat") for i in index],
        *[F.sum(f"{c}{i}").over(place).alias(f"{c}{i}_all") for i in index for c in sums],
        *[F.count_if(F.col(f"n{i}") > 0).over(place).alias(f"cats{i}") for i in index],
    )
    j = p.join(per_site, ["snap", "x", "y", "cat"])

    def results(i, name):
        n = F.col(f"n{i}_all") - 1
        same = F.when(F.col("cat") == "", F.lit(0)).otherwise(F.col(f"n{i}_cat") - 1)

        def share(c):
            return F.when(n > 0, c / n)

        alone = F.when(F.col(f"n{i}_cat") == 1, 1).otherwise(0)
        return [
            n.alias(f"n{name}"),
            share(n - (F.col(f"f{i}_all") - F.col("f"))).alias(f"vacancy{name}"),
            share(F.col(f"cats{i}") - alone).alias(f"diversity{name}"),
            same.cast("long").alias(f"competitors{name}"),
            share(same).alias(f"competition{name}"),
            share(F.col(f"w{i}_all") - F.col("w")).alias(f"turnover{name}"),
        ]

    wanted = [c for i, name in enumerate(radii) for c in results(i, name)]
    return j.select(F.col("snap").alias(snap), F.col("key").alias(key), *wanted)


def neighbourhood(points: DataFrame, radius: float, **options) -> DataFrame:
    """``neighbourhoods`` for one radius; columns carry no suffix."""
    return neighbourhoods(points, {"": radius}, **options)


def candidate_pairs(points: DataFrame, radius: float, snap: str = "anio", x: str = "x", y: str = "y") -> DataFrame:
    """Pairs a plain 3x3 grid would compare against all pairs, per snapshot.

    Arithmetic on cell sizes only; no pair is built.
    """
    cells = points.groupBy(
        F.col(snap).alias("snap"), F.floor(F.col(x) / radius).alias("cx"), F.floor(F.col(y) / radius).alias("cy")
    ).agg(F.count("*").alias("k"))
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in around])
    reach = cells.select("snap", F.col("k").alias("mine"), F.explode(steps).alias("o"), "cx", "cy")
    reach = reach.select("snap", "mine", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
    grid = reach.join(cells, ["snap", "cx", "cy"]).groupBy("snap").agg(F.sum(F.col("mine") * F.col("k")).alias("grid_pairs"))
    full = cells.groupBy("snap").agg((F.sum("k") * F.sum("k")).alias("all_pairs"))
    return grid.join(full, "snap").select(F.col("snap").alias(snap), "grid_pairs", "all_pairs")


def pair_counts(points: DataFrame, radius: float, split: int | None = None, **names) -> DataFrame:
    """Number of ordered neighbour pairs per snapshot (self excluded)."""
    snap = names.get("snap", "anio")
    out = neighbourhood(points, radius, split=split, **names)
    return out.groupBy(snap).agg(F.sum("n").alias("pairs"))


def hexagons(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Hexagon density: axial cell of every point, count and its log.

    Pointy-top hexagons with the given centre-to-corner size; cube rounding.
    """
    q = (F.lit(math.sqrt(3) / 3) * F.col(x) - F.col(y) / 3) / size
    r = (F.lit(2 / 3) * F.col(y)) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    hq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    hr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    cells = points.select(hq.cast("long").alias("q"), hr.cast("long").alias("r"))
    return cells.groupBy("q", "r").agg(F.count("*").alias("n"), F.log10(F.count("*").cast("double")).alias("log_n"))
