"""Neighbourhood queries."""

from pyspark.sql import functions as F

from panelflow.operators import history, neighbourhood
from panelflow.plans.inputs import HISTORY_SQL, SNAPSHOTS_SQL, panel, snapshots, vocabulary
from panelflow.registry.core import query


@query("neighbours_150m", "WITH " + HISTORY_SQL + """,
pt AS (SELECT p.id, p.anio, x, y, division, open, coalesce(turnovers, 0) AS t
       FROM panel p LEFT JOIN hist h ON h.id = p.id AND h.anio = p.anio)
SELECT a.id, a.anio, count(b.id) AS n, round(1 - avg(CAST(b.open AS INT)), 9) AS vacancy,
  round(count(DISTINCT CASE WHEN b.id IS NOT NULL THEN coalesce(b.division, '?') END) / nullif(count(b.id), 0), 9) AS diversity,
  round(avg(b.t), 9) AS turnover
FROM pt a LEFT JOIN pt b ON a.anio = b.anio AND a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 150 * 150
GROUP BY 1, 2""")
def neighbours_150m(spark, d):
    p, v = panel(spark, d), vocabulary(spark, d)
    h = history.history_as_of(p, v, fuzzy=False).select("id", "anio", "turnovers")
    pts = p.join(h, ["id", "anio"], "left")
    return neighbourhood.neighbourhood(pts, 150.0, weight="turnovers").select(
        "id", "anio", "n", *[F.round(c, 9).alias(c) for c in ("vacancy", "diversity", "turnover")]
    )


@query("competitors_200m", "WITH " + SNAPSHOTS_SQL + """
SELECT a.id, a.anio, count(b.id) AS n, count(*) FILTER (WHERE b.division = a.division) AS competitors,
  round(count(*) FILTER (WHERE b.division = a.division) / nullif(count(b.id), 0), 9) AS competition
FROM snaps a LEFT JOIN snaps b ON a.anio = b.anio AND a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 200 * 200
GROUP BY 1, 2""")
def competitors_200m(spark, d):
    return neighbourhood.neighbourhood(snapshots(spark, d), 200.0).select(
        "id", "anio", "n", "competitors", F.round("competition", 9).alias("competition")
    )


@query("neighbour_pairs_per_year", "WITH " + SNAPSHOTS_SQL + """
SELECT a.anio, count(*) AS pairs FROM snaps a JOIN snaps b ON a.anio = b.anio AND a.id <> b.id
  AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 150 * 150 GROUP BY 1""")
def neighbour_pairs_per_year(spark, d):
    return neighbourhood.pair_counts(snapshots(spark, d), 150.0)


@query("grid_candidate_pairs", "WITH " + SNAPSHOTS_SQL + """,
c AS (SELECT anio, CAST(floor(x / 150) AS BIGINT) AS cx, CAST(floor(y / 150) AS BIGINT) AS cy, count(*) AS k FROM snaps GROUP BY 1, 2, 3)
SELECT g.anio, grid_pairs, all_pairs FROM
 (SELECT a.anio, CAST(sum(a.k * b.k) AS BIGINT) AS grid_pairs FROM c a JOIN c b
   ON a.anio = b.anio AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY 1) g
 JOIN (SELECT anio, CAST(sum(k) * sum(k) AS BIGINT) AS all_pairs FROM c GROUP BY 1) t ON t.anio = g.anio""")
def grid_candidate_pairs(spark, d):
    return neighbourhood.candidate_pairs(snapshots(spark, d), 150.0)


@query("hexagon_density", "WITH " + SNAPSHOTS_SQL + """,
a AS (SELECT (sqrt(3.0::DOUBLE) / 3 * x - y / 3) / 200.0::DOUBLE AS q, (2.0::DOUBLE / 3 * y) / 200.0::DOUBLE AS r FROM snaps WHERE open),
b AS (SELECT q, r, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a),
c AS (SELECT CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN -rr - rs ELSE rq END AS hq,
  CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN rr
       WHEN abs(rr - r) > abs(rs - s) THEN -rq - rs ELSE rr END AS hr FROM b)
SELECT CAST(hq AS BIGINT) AS q, CAST(hr AS BIGINT) AS r, count(*) AS n, round(log10(count(*)), 9) AS log_n FROM c GROUP BY 1, 2""")
def hexagon_density(spark, d):
    out = neighbourhood.hexagons(snapshots(spark, d).where("open"), "x", "y", 200.0)
    return out.withColumn("log_n", F.round("log_n", 9))
