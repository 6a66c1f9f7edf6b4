"""Bootstrap intervals and the rules that read them.

Weights come from MD5 digests of the row's id, so SQL repeats them.
"""

from pyspark.sql import functions as F

from panelflow.operators import evaluate, resample
from panelflow.operators.ordered import with_row
from panelflow.plans.inputs import SCORES_SQL, scores
from panelflow.registry.core import query
from panelflow.registry.evaluation import S


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def draws_sql(replicates: int, columns: str, seed: int = 0) -> str:
    """CTE ``b`` (r, w, columns): every row of ``scores`` with its weight in every replicate, zeros left out."""
    steps = " + ".join(f"CAST(u >= {s} AS INT)" for s in resample.poisson_steps())
    return f""",
u AS (SELECT {columns}, r, CAST('0x' || substr(md5('{seed}-' || CAST(id AS VARCHAR) || '-' || CAST(r // 4 AS VARCHAR)), 1 + 8 * (r % 4), 8) AS BIGINT) AS u
  FROM scores, (SELECT CAST(range AS INT) AS r FROM range({replicates}))),
b AS (SELECT *, {steps} AS w FROM u WHERE u >= {resample.poisson_steps()[0]})"""


def metrics_sql(models: dict[str, str]) -> str:
    """CTE ``m`` (model, r, auc, lift, brier) over ``b``; ``models`` maps a name to its score column."""
    long = " UNION ALL ".join(f"SELECT '{name}' AS model, r, w, y, {p} AS p FROM b" for name, p in models.items())
    return f""",
v AS (SELECT model, r, p, sum(w) AS n, sum(w * y) AS pos FROM ({long}) GROUP BY 1, 2, 3),
x AS (SELECT *, sum(n) OVER g AS tn, sum(pos) OVER g AS tp, sum(n - pos) OVER o - (n - pos) AS nb, sum(n) OVER g - sum(n) OVER o AS above
  FROM v WINDOW g AS (PARTITION BY model, r), o AS (PARTITION BY model, r ORDER BY p ROWS UNBOUNDED PRECEDING)),
m AS (SELECT model, r, sum(pos * (nb + (n - pos) / 2)) / nullif(max(tp * (tn - tp)), 0) AS auc,
    sum(pos * least(greatest(greatest(1, floor(tn * 0.1)) - above, 0), n) / n) / max(greatest(1, floor(tn * 0.1))) / (max(tp) / max(tn)) AS lift,
    sum(pos * (1 - p) ** 2 + (n - pos) * p ** 2) / max(tn) AS brier
  FROM x GROUP BY 1, 2 HAVING max(tp) >= {resample.MIN_POSITIVES})"""


def interval_sql(columns: list[str]) -> str:
    return ", ".join(
        f"round(quantile_cont({c}, 0.025), 6) AS {c}_lo, round(quantile_cont({c}, 0.975), 6) AS {c}_hi, round(avg({c}), 6) AS {c}_mean" for c in columns)


def names(columns: list[str]) -> list[str]:
    return [f"{c}_{k}" for c in columns for k in ("lo", "hi", "mean")]


METRICS, CHANGES = ["auc", "lift", "brier"], ["d_auc", "d_lift", "d_brier"]
PAIRED = S + draws_sql(500, "id, y, p, p2") + metrics_sql({"p": "p", "p2": "p2"}) + """,
d AS (SELECT a.model, a.auc - z.auc AS d_auc, a.lift - z.lift AS d_lift, a.brier - z.brier AS d_brier
  FROM m a JOIN m z ON z.r = a.r AND z.model = 'p' WHERE a.model <> 'p')"""


@query("bootstrap_interval", S + draws_sql(500, "id, y, p") + metrics_sql({"p": "p"}) + f"SELECT count(*) AS replicates, {interval_sql(METRICS)} FROM m")
def bootstrap_interval(spark, d):
    return r6(resample.bootstrap(scores(spark, d), replicates=500, key="id"), *names(METRICS))


@query("paired_bootstrap", PAIRED + f" SELECT model, count(*) AS replicates, {interval_sql(CHANGES)} FROM d GROUP BY 1")
def paired_bootstrap(spark, d):
    return r6(_paired(spark, d), *names(CHANGES))


def _paired(spark, d):
    return resample.paired_differences(scores(spark, d), "p", ["p2"], replicates=500, key="id")


SPEARMAN = "WITH " + SCORES_SQL + draws_sql(2000, "id, y, p, h") + """,
a AS (SELECT r, h, round(sum(w * y) / sum(w), 12) AS observed, round(sum(w * p) / sum(w), 12) AS predicted FROM b GROUP BY 1, 2),
k AS (SELECT r, rank() OVER (PARTITION BY r ORDER BY observed) + (count(*) OVER (PARTITION BY r, observed) - 1) / 2 AS ro,
  rank() OVER (PARTITION BY r ORDER BY predicted) + (count(*) OVER (PARTITION BY r, predicted) - 1) / 2 AS rp FROM a),
c AS (SELECT r, corr(ro, rp) AS rho FROM k GROUP BY 1),
i AS (SELECT count(*) AS replicates, quantile_cont(rho, 0.025) AS rho_lo, quantile_cont(rho, 0.975) AS rho_hi, avg(rho) AS rho_mean
  FROM c WHERE rho IS NOT NULL AND NOT isnan(rho)),
p0 AS (SELECT h, avg(y) AS observed, avg(p) AS predicted FROM scores GROUP BY 1),
k0 AS (SELECT rank() OVER (ORDER BY observed) + (count(*) OVER (PARTITION BY observed) - 1) / 2 AS ro,
  rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS rp FROM p0),
z AS (SELECT corr(ro, rp) AS rho FROM k0)
SELECT replicates, round(rho_lo, 6) AS rho_lo, round(rho_hi, 6) AS rho_hi, round(rho_mean, 6) AS rho_mean, round(rho, 6) AS rho,
  CASE WHEN rho_lo < 0.2 THEN 'too noisy' WHEN rho < 0.5 THEN 'weak' ELSE 'ok' END AS reading FROM i, z"""


@query("spearman_interval", SPEARMAN)
def spearman_interval(spark, d):
    s = scores(spark, d)
    iv = resample.spearman_interval(s, "h", replicates=2000, key="id")
    rho = evaluate.spearman_of_areas(evaluate.area_means(s, "h")).select("rho")
    return r6(resample.district_reading(with_row(iv, rho)), "rho_lo", "rho_hi", "rho_mean", "rho")


@query("regression_interval", S + draws_sql(500, "id, y, p") + f""",
s AS (SELECT r, sum(w) AS n, sum(w * abs(y - p)) AS ae, sum(w * (y - p) ** 2) AS se, sum(w * y) AS sy, sum(w * y * y) AS syy FROM b GROUP BY 1),
m AS (SELECT ae / n AS mae, 1 - se / nullif(syy - sy * sy / n, 0) AS r2 FROM s)
SELECT count(*) AS replicates, {interval_sql(["mae", "r2"])} FROM m""")
def regression_interval(spark, d):
    return r6(resample.regression_interval(scores(spark, d), "y", "p", replicates=500, key="id"), *names(["mae", "r2"]))


POINT = """,
t0 AS (SELECT model, p, count(*) AS n, sum(y) AS pos FROM (SELECT 'p' AS model, y, p FROM scores UNION ALL SELECT 'p2', y, p2 FROM scores) GROUP BY 1, 2),
x0 AS (SELECT *, sum(n) OVER (PARTITION BY model) AS tn, sum(pos) OVER (PARTITION BY model) AS tp,
  sum(n) OVER (PARTITION BY model) - sum(n) OVER (PARTITION BY model ORDER BY p ROWS UNBOUNDED PRECEDING) AS above FROM t0),
l0 AS (SELECT model, sum(pos * least(greatest(greatest(1, floor(tn * 0.1)) - above, 0), n) / n) / max(greatest(1, floor(tn * 0.1))) / (max(tp) / max(tn)) AS lift
  FROM x0 GROUP BY 1),
iv AS (SELECT model, quantile_cont(d_lift, 0.025) AS lo, quantile_cont(d_lift, 0.975) AS hi, quantile_cont(d_brier, 0.025) AS blo FROM d GROUP BY 1)"""


def _point(spark, d):
    """(model, lift) of both scores."""
    s = scores(spark, d)
    both = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in ("p", "p2")])).alias("m"), "y").select("m.*", "y")
    return evaluate.ranking_metrics(both, "y", "p", ["model"]).select("model", "lift")


@query("technique_verdicts_bootstrap", PAIRED + POINT + """
SELECT i.model, round(a.lift - z.lift, 6) AS d_lift, round(lo, 6) AS d_lift_lo, round(hi, 6) AS d_lift_hi,
  CASE WHEN lo <= 0 AND hi >= 0 THEN 'ties' WHEN a.lift > z.lift THEN 'better' ELSE 'worse' END AS verdict
FROM iv i JOIN l0 a ON a.model = i.model JOIN l0 z ON z.model = 'p'""")
def technique_verdicts_bootstrap(spark, d):
    out = resample.paired_verdicts(_point(spark, d), _paired(spark, d).select("model", "d_lift_lo", "d_lift_hi"), "p")
    return r6(out, "d_lift", "d_lift_lo", "d_lift_hi")


@query("champion_bootstrap", PAIRED + POINT + """,
c AS (SELECT l.model, lift, CASE l.model WHEN 'p' THEN 2 ELSE 1 END AS n_vars, lo, hi FROM l0 l LEFT JOIN iv ON iv.model = l.model),
k AS (SELECT model AS leader, n_vars AS lv FROM c ORDER BY lift DESC, model LIMIT 1),
t AS (SELECT c.*, leader, model = leader OR coalesce(n_vars < lv AND lo <= 0 AND hi >= 0, false) AS tied FROM c, k)
SELECT max(leader) AS leader, count(*) FILTER (WHERE tied) AS n_tied,
  (SELECT model FROM t WHERE tied ORDER BY n_vars, CASE WHEN model = leader THEN 0 ELSE 1 END, model LIMIT 1) AS champion FROM t""")
def champion_bootstrap(spark, d):
    size = F.when(F.col("model") == "p", 2).otherwise(1)
    return resample.choose_champion(_point(spark, d).withColumn("n_vars", size), _paired(spark, d).select("model", "d_lift_lo", "d_lift_hi"))


@query("acceptance_bootstrap", PAIRED + POINT + """,
g AS (SELECT h, count(*) AS n, stddev_samp(p2) / nullif(avg(p2), 0) AS cv FROM scores GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT sum(coalesce(cv, 0) * n) / sum(n) AS cv FROM g)
SELECT model, round(cv, 6) AS cv_weighted, CASE WHEN lo > 0 THEN 'performance' WHEN lo <= 0 AND hi >= 0 AND cv > 0.35 AND blo <= 0 THEN 'utility' ELSE 'keep' END AS verdict
FROM iv, w""")
def acceptance_bootstrap(spark, d):
    from panelflow.operators import rollup

    cv = rollup.dispersion(scores(spark, d), "p2", ["h"]).select("cv_weighted")
    out = resample.acceptance(with_row(_paired(spark, d), cv))
    return r6(out.select("model", "cv_weighted", "verdict"), "cv_weighted")
