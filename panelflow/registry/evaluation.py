"""Evaluation statistics, rankings and drift."""

from pyspark.sql import functions as F

from panelflow.functions.numbers import ratio_to_base, risk_band, wilson
from panelflow.operators import drift, evaluate, ranking, reconcile, resample, rollup
from panelflow.operators.ordered import exact_quantiles, rank_buckets, with_row
from panelflow.plans.inputs import SCORES_SQL, scores, table
from panelflow.registry.core import query

S = "WITH " + SCORES_SQL


def r9(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


METRICS_SQL = """,
t AS (SELECT {by} p, count(*) AS n, sum(y) AS pos FROM scores GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w - n AS nb, sum(pos) OVER w - pos AS pb, sum(n) OVER g AS tn, sum(pos) OVER g AS tp
  FROM t WINDOW w AS ({part} ORDER BY p ROWS UNBOUNDED PRECEDING), g AS ({part}))
SELECT {by} CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS positives, round(max(tp) / max(tn), 9) AS base_rate,
  round(sum(pos * (nb - pb + (n - pos) / 2)) / max(tp * (tn - tp)), 9) AS auc,
  round(sum(pos * (tp - pb) / (tn - nb)) / max(tp), 9) AS average_precision,
  round(sum(pos * (1 - p) ** 2 + (n - pos) * p ** 2) / max(tn), 9) AS brier,
  round(sum(pos * least(greatest(greatest(1, floor(tn * 0.1)) - (tn - nb - n), 0), n) / n)
    / max(greatest(1, floor(tn * 0.1))) / (max(tp) / max(tn)), 9) AS lift
FROM c {grp}"""
M = ("base_rate", "auc", "average_precision", "brier", "lift")


@query("ranking_metrics", S + METRICS_SQL.format(by="", part="", grp=""))
def ranking_metrics(spark, d):
    return r9(evaluate.ranking_metrics(scores(spark, d)), *M)


@query("ranking_metrics_by_group", S + METRICS_SQL.format(by="g,", part="PARTITION BY g", grp="GROUP BY g"))
def ranking_metrics_by_group(spark, d):
    return r9(evaluate.ranking_metrics(scores(spark, d), by=["g"]), *M)


@query("auc", S + """
SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 9) AS auc
FROM scores a, scores b WHERE a.y = 1 AND b.y = 0""")
def auc(spark, d):
    return r9(evaluate.ranking_metrics(scores(spark, d)).select("auc"), "auc")


@query("brier_by_group", S + " SELECT g, round(avg((p - y) ** 2), 9) AS brier FROM scores GROUP BY 1")
def brier_by_group(spark, d):
    return r9(evaluate.brier(scores(spark, d), by=["g"]), "brier")


@query("lift_by_rank", S + """,
k AS (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS k, avg(y) AS base FROM scores),
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rn FROM scores)
SELECT count(*) AS n_top, round(avg(y) / max(base), 9) AS lift FROM r, k WHERE rn <= k""")
def lift_by_rank(spark, d):
    return r9(evaluate.lift_by_rank(scores(spark, d)), "lift")


@query("precision_at_100", S + """
SELECT CAST(sum(y) AS BIGINT) AS hits, round(avg(y), 9) AS precision FROM (SELECT y FROM scores ORDER BY p DESC, id LIMIT 100)""")
def precision_at_100(spark, d):
    return r9(evaluate.precision_at(scores(spark, d), 100), "precision")


DEC = """, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rn, count(*) OVER () AS n FROM scores),
dec AS (SELECT *, CAST(greatest(1, ceil((rn - 1) * 10 / (n - 1))) AS INT) AS decile FROM r)"""


@query("score_deciles", S + DEC + " SELECT id, p, decile FROM dec")
def score_deciles(spark, d):
    return rank_buckets(scores(spark, d), "p", "id").select("id", "p", "decile")


@query("decile_table", S + DEC + """ SELECT decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, round(avg(y), 9) AS rate,
  round(avg(y) / (SELECT avg(y) FROM scores), 9) AS lift FROM dec GROUP BY 1""")
def decile_table(spark, d):
    return r9(evaluate.decile_table(scores(spark, d)), "rate", "lift")


@query("decile_monotone", S + DEC + """, t AS (SELECT decile, avg(y) AS rate FROM dec GROUP BY 1),
l AS (SELECT rate, lag(rate) OVER (ORDER BY decile) AS prev FROM t)
SELECT count(*) FILTER (WHERE rate < prev) AS n_drops, CAST(bool_and(coalesce(rate >= prev, true)) AS INT) AS monotone FROM l""")
def decile_monotone(spark, d):
    return evaluate.is_monotone(evaluate.decile_table(scores(spark, d)))


CAL = """SELECT bin, count(*) AS n, round(avg(p), 9) AS predicted, round(avg(y), 9) AS observed FROM (
  SELECT p, y, CASE {cases} END AS bin FROM scores) WHERE bin IS NOT NULL GROUP BY 1 HAVING count(*) >= {m}"""


def _cases(edges, right):
    op, first = ("<=", f"WHEN p <= {edges[0]} THEN NULL ") if right else ("<", f"WHEN p < {edges[0]} THEN NULL ")
    return first + " ".join(f"WHEN p {op} {e} THEN {k}" for k, e in enumerate(edges[1:], 1))


@query("calibration_right_closed", S + CAL.format(cases=_cases(evaluate.CALIBRATION_RIGHT_CLOSED, True), m=0))
def calibration_right_closed(spark, d):
    return r9(evaluate.calibration_table(scores(spark, d)), "predicted", "observed")


@query("calibration_left_closed", S + CAL.format(cases=_cases((0, 0.2, 0.4, 0.6, 0.8, 1.01), False), m=20))
def calibration_left_closed(spark, d):
    out = evaluate.calibration_table(scores(spark, d), (0, 0.2, 0.4, 0.6, 0.8, 1.01), False, 20)
    return r9(out, "predicted", "observed")


@query("spearman_by_area", S + """,
a AS (SELECT h, avg(y) AS observed, avg(p) AS predicted FROM scores GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY observed) + (count(*) OVER (PARTITION BY observed) - 1) / 2 AS ro,
  rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS rp FROM a),
c AS (SELECT count(*) AS n_areas, corr(ro, rp) AS rho FROM r)
SELECT n_areas, round(rho, 9) AS rho, round(rho * sqrt(n_areas - 2) / sqrt(1 - rho * rho), 6) AS t FROM c""")
def spearman_by_area(spark, d):
    a = evaluate.area_means(scores(spark, d), "h")
    return evaluate.spearman_of_areas(a).select("n_areas", F.round("rho", 9).alias("rho"), F.round("t", 6).alias("t"))


@query("regression_metrics", S + """
SELECT g, count(*) AS n, round(avg(abs(y - p)), 9) AS mae, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 9) AS r2
FROM (SELECT *, avg(y) OVER (PARTITION BY g) AS m FROM scores) GROUP BY 1""")
def regression_metrics(spark, d):
    return r9(evaluate.regression_metrics(scores(spark, d), "y", "p", ["g"]), "mae", "r2")


@query("baseline_verdicts", S + """,
m AS (SELECT g AS model, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / sum((y - m) ** 2) AS r2
  FROM (SELECT *, avg(y) OVER (PARTITION BY g) AS m FROM scores) GROUP BY 1)
SELECT a.model, round(a.mae - b.mae, 9) AS d_mae, round(a.r2 - b.r2, 9) AS d_r2,
  CASE WHEN a.mae < b.mae AND a.r2 > b.r2 THEN 'better' WHEN a.mae >= b.mae THEN 'does not beat baseline' ELSE 'mixed' END AS verdict
FROM m a, m b WHERE b.model = 'en' AND a.model <> 'en'""")
def baseline_verdicts(spark, d):
    m = evaluate.regression_metrics(scores(spark, d), "y", "p", ["g"]).withColumnRenamed("g", "model")
    return r9(evaluate.baseline_verdicts(m, "model", "en"), "d_mae", "d_r2")


@query("wilson_by_group", S + """,
w AS (SELECT h, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM scores GROUP BY 1)
SELECT h, round(k / n, 9) AS rate,
  round(greatest(0, (k/n + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS low,
  round(least(1, (k/n + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS high FROM w""")
def wilson_by_group(spark, d):
    g = scores(spark, d).groupBy("h").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return r9(g.select("h", wilson("k", "n").alias("w")).select("h", "w.*"), "rate", "low", "high")


@query("champion_choice", S + """,
c AS (SELECT h AS model, avg(p) AS lift, count(DISTINCT g) AS n_vars, avg(y) - 0.1 AS lo, avg(y) - 0.05 AS hi FROM scores GROUP BY 1),
l AS (SELECT model AS leader, n_vars AS lv FROM c ORDER BY lift DESC, model LIMIT 1),
t AS (SELECT c.*, leader, model = leader OR (n_vars < lv AND lo <= 0 AND hi >= 0) AS tied FROM c, l)
SELECT max(leader) AS leader, count(*) FILTER (WHERE tied) AS n_tied,
  (SELECT model FROM t WHERE tied ORDER BY n_vars, CASE WHEN model = leader THEN 0 ELSE 1 END, model LIMIT 1) AS champion FROM t""")
def champion_choice(spark, d):
    c = scores(spark, d).groupBy(F.col("h").alias("model")).agg(
        F.avg("p").alias("lift"), F.count_distinct("g").alias("n_vars"),
        (F.avg("y") - 0.1).alias("d_lift_lo"), (F.avg("y") - 0.05).alias("d_lift_hi"),
    )
    return resample.choose_champion(c.select("model", "lift", "n_vars"), c.select("model", "d_lift_lo", "d_lift_hi"))


@query("technique_verdicts", S + """,
c AS (SELECT h AS model, avg(p) AS lift, avg(y) - 0.15 AS lo, avg(y) - 0.1 AS hi FROM scores GROUP BY 1)
SELECT a.model, round(a.lift - b.lift, 9) AS d_lift, round(a.lo, 9) AS d_lift_lo, round(a.hi, 9) AS d_lift_hi,
  CASE WHEN a.lo <= 0 AND a.hi >= 0 THEN 'ties' WHEN a.lift > b.lift THEN 'better' ELSE 'worse' END AS verdict
FROM c a, c b WHERE b.model = 'src1'""")
def technique_verdicts(spark, d):
    c = scores(spark, d).groupBy(F.col("h").alias("model")).agg(
        F.avg("p").alias("lift"), (F.avg("y") - 0.15).alias("d_lift_lo"), (F.avg("y") - 0.1).alias("d_lift_hi")
    )
    out = resample.paired_verdicts(c.select("model", "lift"), c.select("model", "d_lift_lo", "d_lift_hi"), "src1")
    return r9(out, "d_lift", "d_lift_lo", "d_lift_hi")


@query("acceptance_rule", S + """,
c AS (SELECT h AS model, avg(y) - 0.15 AS lo, avg(y) - 0.1 AS hi, avg(p) - 0.5 AS blo, stddev_samp(p) / avg(p) AS cv FROM scores GROUP BY 1)
SELECT model, CASE WHEN lo > 0 THEN 'performance' WHEN lo <= 0 AND hi >= 0 AND cv > 0.35 AND blo <= 0 THEN 'utility' ELSE 'keep' END AS verdict
FROM c""")
def acceptance_rule(spark, d):
    c = scores(spark, d).groupBy(F.col("h").alias("model")).agg(
        (F.avg("y") - 0.15).alias("d_lift_lo"), (F.avg("y") - 0.1).alias("d_lift_hi"),
        (F.avg("p") - 0.5).alias("d_brier_lo"), (F.stddev_samp("p") / F.avg("p")).alias("cv_weighted"),
    )
    return resample.acceptance(c).select("model", "verdict")


@query("district_order_reading", S + """,
c AS (SELECT h, avg(p) AS rho, avg(y) * 3 AS rho_lo FROM scores GROUP BY 1)
SELECT h, CASE WHEN rho_lo < 0.2 THEN 'too noisy' WHEN rho < 0.5 THEN 'weak' ELSE 'ok' END AS reading FROM c""")
def district_order_reading(spark, d):
    c = scores(spark, d).groupBy("h").agg(F.avg("p").alias("rho"), (F.avg("y") * 3).alias("rho_lo"))
    return resample.district_reading(c).select("h", "reading")


@query("quintiles_of_value", S + """,
e AS (SELECT quantile_cont(p2, [0.2, 0.4, 0.6, 0.8]) AS q FROM scores)
SELECT quintile, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, round(avg(y), 9) AS rate FROM (
  SELECT y, CASE WHEN p2 <= q[1] THEN 1 WHEN p2 <= q[2] THEN 2 WHEN p2 <= q[3] THEN 3 WHEN p2 <= q[4] THEN 4 ELSE 5 END AS quintile
  FROM scores, e) GROUP BY 1""")
def quintiles_of_value(spark, d):
    return r9(rollup.size_sum_mean(evaluate.value_quintiles(scores(spark, d), "p2"), ["quintile"], "y"), "rate")


@query("decile_in_reference", S + """
SELECT a.id, a.p2, CAST(least(floor(10 * (SELECT count(*) FROM scores b WHERE b.p < a.p2) / (SELECT count(*) FROM scores)) + 1, 10) AS INT) AS decile
FROM scores a""")
def decile_in_reference(spark, d):
    s = scores(spark, d)
    return evaluate.reference_decile(s.select("id", "p2"), s.select(F.col("p").alias("p2")), "p2")


@query("psi_categorical", """WITH e AS (SELECT l_returnflag AS bin, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1),
o AS (SELECT l_returnflag AS bin, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1),
b AS (SELECT bin FROM e UNION ALL SELECT '· other ·'),
s AS (SELECT b.bin, coalesce(e.n, 0) / (SELECT sum(n) FROM e) AS pe, coalesce(o.n, 0) / (SELECT sum(n) FROM o) AS po
  FROM b LEFT JOIN e ON e.bin = b.bin LEFT JOIN o ON o.bin = b.bin)
SELECT bin, round(pe, 9) AS expected, round(po, 9) AS observed,
  round((greatest(po, 1e-4) - greatest(pe, 1e-4)) * ln(greatest(po, 1e-4) / greatest(pe, 1e-4)), 9) AS psi_bin FROM s""")
def psi_categorical(spark, d):
    e, o = _drift_sides(spark, d)
    return r9(drift.psi_categorical(e, o, "l_returnflag"), "expected", "observed", "psi_bin")


def _drift_sides(spark, d):
    t = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate")
    return t.where(F.year("l_shipdate") == 1995), t.where(F.year("l_shipdate") == 1997)


def _psi_sql(col):
    return f"""WITH x AS (SELECT {col} AS v, year(l_shipdate) AS yr FROM lineitem),
q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM x WHERE yr = 1995),
b AS (SELECT yr, len(list_filter(e[2:len(e) - 1], lambda t: t < v)) + 1 AS bin FROM x, q WHERE yr IN (1995, 1997)),
s AS (SELECT bin, count(*) FILTER (WHERE yr = 1995) / (SELECT count(*) FROM b WHERE yr = 1995) AS pe,
  count(*) FILTER (WHERE yr = 1997) / (SELECT count(*) FROM b WHERE yr = 1997) AS po FROM b GROUP BY 1)
SELECT CAST(bin AS VARCHAR) AS bin, round(pe, 9) AS expected, round(po, 9) AS observed,
  round((greatest(po, 1e-4) - greatest(pe, 1e-4)) * ln(greatest(po, 1e-4) / greatest(pe, 1e-4)), 9) AS psi_bin FROM s"""


@query("psi_numeric_price", _psi_sql("l_extendedprice"))
def psi_numeric_price(spark, d):
    e, o = _drift_sides(spark, d)
    return r9(drift.psi_numeric(e, o, "l_extendedprice"), "expected", "observed", "psi_bin")


@query("psi_numeric_quantity", _psi_sql("l_quantity"))
def psi_numeric_quantity(spark, d):
    e, o = _drift_sides(spark, d)
    return r9(drift.psi_numeric(e, o, "l_quantity"), "expected", "observed", "psi_bin")


@query("drift_verdict", f"""WITH p1 AS (SELECT sum(psi_bin) AS psi FROM ({_psi_sql("l_extendedprice")})),
p2 AS (SELECT sum(psi_bin) AS psi FROM ({_psi_sql("l_quantity")})),
u AS (SELECT 'price' AS variable, psi FROM p1 UNION ALL SELECT 'quantity', psi FROM p2)
SELECT round(max(psi), 6) AS worst_psi, arg_max(variable, psi) AS worst_variable,
  (SELECT count(*) FROM lineitem WHERE year(l_shipdate) = 1997) AS n_observed,
  CASE WHEN max(psi) < 0.1 THEN 'stable' WHEN max(psi) < 0.25 THEN 'moderate drift' ELSE 'high drift' END AS conclusion FROM u""")
def drift_verdict(spark, d):
    e, o = _drift_sides(spark, d)
    psis = drift.total_psi(drift.psi_numeric(e, o, "l_extendedprice"), "price").unionByName(
        drift.total_psi(drift.psi_numeric(e, o, "l_quantity"), "quantity")
    )
    return drift.drift_report(psis, o.agg(F.count("*")).scalar()).withColumn("worst_psi", F.round("worst_psi", 6))


@query("dispersion", S + """,
ties AS (SELECT p, count(*) AS n FROM scores GROUP BY 1),
g AS (SELECT count(*) AS n, avg(p) AS m, stddev_samp(p) AS s FROM scores GROUP BY g, h HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM ties) AS n_distinct,
  round((SELECT sum(CASE WHEN n >= 11 THEN n ELSE 0 END) / sum(n) FROM ties), 9) AS share_tied,
  round((SELECT stddev_samp(p) FROM scores), 9) AS std,
  round((SELECT quantile_cont(p, 0.75) - quantile_cont(p, 0.25) FROM scores), 9) AS iqr,
  (SELECT count(*) FROM g) AS n_groups, round((SELECT avg(coalesce(s / nullif(m, 0), 0)) FROM g), 9) AS cv_simple,
  round((SELECT sum(coalesce(s / nullif(m, 0), 0) * n) / sum(n) FROM g), 9) AS cv_weighted""")
def dispersion(spark, d):
    return r9(rollup.dispersion(scores(spark, d), "p", ["g", "h"]), "share_tied", "std", "iqr", "cv_simple", "cv_weighted")


@query("tie_groups", S + " SELECT p, count(*) AS n FROM scores GROUP BY 1")
def tie_groups(spark, d):
    return rollup.tie_groups(scores(spark, d), "p")


@query("top_20_scores", S + " SELECT id, p, g, h FROM scores ORDER BY p DESC, id LIMIT 20")
def top_20_scores(spark, d):
    return ranking.top_k(scores(spark, d).select("id", "p", "g", "h"), "p", "id", 20)


@query("typical_rows", S + """,
m AS (SELECT h, quantile_cont(p, 0.5) AS median FROM scores GROUP BY 1)
SELECT h, id, p, median FROM (SELECT s.h, id, p, median, row_number() OVER (PARTITION BY s.h ORDER BY abs(p - median), id) AS rn
  FROM scores s JOIN m ON m.h = s.h) WHERE rn = 1""")
def typical_rows(spark, d):
    s = scores(spark, d).select("h", "id", "p")
    med = exact_quantiles(s, "p", {"median": 0.5}, ["h"])
    return evaluate.typical_rows(s, "h", "p", "id").join(med, "h")


@query("stable_sample", S + " SELECT id, y FROM scores ORDER BY md5(CAST(id AS VARCHAR) || '-2024'), id LIMIT 40")
def stable_sample(spark, d):
    return ranking.stable_sample(scores(spark, d).select("id", "y"), 40, "id", 2024)


@query("risk_bands", S + """ SELECT CASE WHEN p / 10 < 0.04 THEN 'LOW' WHEN p / 10 < 0.08 THEN 'MEDIUM' ELSE 'HIGH' END AS band, count(*) AS n FROM scores GROUP BY 1""")
def risk_bands(spark, d):
    return scores(spark, d).groupBy(risk_band(F.col("p") / 10).alias("band")).agg(F.count("*").alias("n"))


@query("ratio_to_base_rate", S + " SELECT id, round(p / (SELECT avg(y) FROM scores), 3) AS ratio FROM scores")
def ratio_to_base_rate(spark, d):
    s = scores(spark, d)
    return s.select("id", F.round(ratio_to_base("p", s.agg(F.avg("y")).scalar()), 3).alias("ratio"))


@query("soft_vote", S + " SELECT id, round((p + p2) / 2, 9) AS p_vote FROM scores")
def soft_vote(spark, d):
    return r9(evaluate.ensemble(scores(spark, d), ["p", "p2"]).select("id", "p_vote"), "p_vote")


@query("rare_drawer", S + """,
f AS (SELECT h, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, h) AS rk, count(*) OVER () AS t FROM scores GROUP BY 1),
r AS (SELECT h FROM f WHERE rk > CASE WHEN t > 12 THEN 11 ELSE t END OR n < 10)
SELECT count(r.h) AS rows_in_drawer, round(avg(CAST(r.h IS NOT NULL AS INT)), 9) AS share_in_drawer,
  (SELECT count(*) FROM r) AS categories_in_drawer FROM scores s LEFT JOIN r ON r.h = s.h""")
def rare_drawer(spark, d):
    s = scores(spark, d)
    return r9(rollup.rare_drawer(s, s, "h", 12, 10), "share_in_drawer")


@query("reconcile_tables", S + """,
a AS (SELECT h, count(*) AS n, avg(p) AS m FROM scores GROUP BY 1),
b AS (SELECT h, count(*) + CASE WHEN h = 'src1' THEN 1 ELSE 0 END AS n, avg(p) + CASE WHEN h = 'src2' THEN 0.5 ELSE 0 END AS m FROM scores GROUP BY 1)
SELECT 'n' AS variable, count(*) AS n, count(*) FILTER (WHERE a.n = b.n) AS n_equal, max(abs(a.n - b.n))::DOUBLE AS max_difference FROM a JOIN b USING (h)
UNION ALL SELECT 'm', count(*), count(*) FILTER (WHERE abs(a.m - b.m) <= 1e-9), round(max(abs(a.m - b.m)), 9) FROM a JOIN b USING (h)""")
def reconcile_tables(spark, d):
    a = scores(spark, d).groupBy("h").agg(F.count("*").alias("n"), F.avg("p").alias("m"))
    b = a.select(
        "h", (F.col("n") + F.when(F.col("h") == "src1", 1).otherwise(0)).alias("n"),
        (F.col("m") + F.when(F.col("h") == "src2", 0.5).otherwise(0.0)).alias("m"),
    )
    return r9(reconcile.compare(a, b, ["h"], {"n": 0, "m": reconcile.RATIO_TOLERANCE}), "max_difference")


@query("reconcile_differing_rows", S + """
SELECT h, n AS n_a, n + 1 AS n_b FROM (SELECT h, count(*) AS n FROM scores GROUP BY 1) WHERE n % 2 = 0 ORDER BY h LIMIT 5""")
def reconcile_differing_rows(spark, d):
    a = scores(spark, d).groupBy("h").agg(F.count("*").alias("n"))
    b = a.withColumn("n", F.col("n") + F.when(F.col("n") % 2 == 0, 1).otherwise(0))
    return reconcile.differing_rows(a, b, ["h"], {"n": 0})


@query("ids_on_one_side", """SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def ids_on_one_side(spark, d):
    return reconcile.one_sided(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("set_difference", "SELECT l_partkey AS k FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def set_difference(spark, d):
    return reconcile.difference(
        table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    )


@query("quantiles_by_group", S + """
SELECT g, count(p) AS n, round(avg(p), 9) AS mean, round(quantile_cont(p, 0.5), 9) AS median, round(quantile_cont(p, 0.9), 9) AS p90 FROM scores GROUP BY 1""")
def quantiles_by_group(spark, d):
    return r9(rollup.group_quantile_summary(scores(spark, d), ["g"], "p"), "mean", "median", "p90")


@query("five_number_summary", """SELECT count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM (SELECT l_extendedprice AS v FROM lineitem)""")
def five_number_summary(spark, d):
    out = rollup.five_numbers(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v")), "v")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p25", "median", "p75")})
