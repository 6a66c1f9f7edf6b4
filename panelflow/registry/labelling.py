"""Snapshot pairs, churn labels and longitudinal features."""

from pyspark.sql import functions as F

from panelflow.functions.text import normalise
from panelflow.operators import brand, history, pairs, rollup
from panelflow.plans.inputs import (
    HISTORY_SQL, PAIRS_SQL, PANEL_SQL, RAW_SQL, likely_sql, panel, ratio_sql, raw_rows, same_sql, vocabulary,
)
from panelflow.registry.core import query
from panelflow.session import scratch_path


def labelled(spark, d, fuzzy=False, **kw):
    return pairs.label_pairs(panel(spark, d), vocabulary(spark, d), fuzzy=fuzzy, **kw)


@query("panel_table", "WITH " + PANEL_SQL + """
SELECT id, anio, norm, CAST(open AS INT) AS is_open, division, district, barrio, x, y FROM panel""")
def panel_table(spark, d):
    return panel(spark, d).select(
        "id", "anio", "norm", F.col("open").cast("int").alias("is_open"), "division", "district", "barrio", "x", "y"
    )


@query("panel_identity_words", "WITH " + PANEL_SQL + """
SELECT id, anio, norm, CAST(ph AS INT) AS placeholder, CAST(len(core) = 0 AS INT) AS is_generic,
  array_to_string(core, '|') AS core_key FROM panel""")
def panel_identity_words(spark, d):
    from panelflow.functions.text import core_key, is_generic, is_placeholder

    v = vocabulary(spark, d)
    return panel(spark, d).select(
        "id", "anio", "norm", is_placeholder("norm").cast("int").alias("placeholder"),
        is_generic("norm", v).cast("int").alias("is_generic"), core_key("norm", v).alias("core_key"),
    )


@query("snapshot_pairs", "WITH " + PAIRS_SQL + """
SELECT id, cohort, CAST(present AS INT) AS present, CAST(open1 AS INT) AS open1, norm, norm1 FROM pairs""")
def snapshot_pairs(spark, d):
    return pairs.snapshot_pairs(panel(spark, d)).select(
        "id", "cohort", F.col("present").cast("int").alias("present"), F.col("open1").cast("int").alias("open1"), "norm", "norm1"
    )


@query("labelled_pairs", "WITH " + PAIRS_SQL + """
SELECT id, cohort, CAST(gone AS INT) AS gone, CAST(closed AS INT) AS closed, CAST(rotated AS INT) AS rotated, target
FROM labelled""")
def labelled_pairs(spark, d):
    return labelled(spark, d).select(
        "id", "cohort", *[F.col(c).cast("int").alias(c) for c in ("gone", "closed", "rotated", "target")]
    )


FUZZY = "WITH RECURSIVE " + PAIRS_SQL + likely_sql("SELECT norm AS a, norm1 AS b FROM labelled WHERE differs AND NOT same") + """,
fuzzy AS (SELECT l.*, differs AND NOT same AND k.a IS NULL AS rot FROM labelled l LEFT JOIN likely k ON k.a = norm AND k.b = norm1)"""


@query("labelled_pairs_fuzzy", FUZZY + """
SELECT id, cohort, norm, norm1, CAST(gone AS INT) AS gone, CAST(closed AS INT) AS closed, CAST(rot AS INT) AS rotated,
  CAST(gone OR closed OR rot AS INT) AS target FROM fuzzy""")
def labelled_pairs_fuzzy(spark, d):
    return labelled(spark, d, fuzzy=True).select(
        "id", "cohort", "norm", "norm1", *[F.col(c).cast("int").alias(c) for c in ("gone", "closed", "rotated", "target")]
    )


@query("turnover_by_cohort", "WITH " + PAIRS_SQL + """
SELECT o.cohort, n_open, excluded, universe, share_gone, share_closed, share_rotated, churn
FROM (SELECT cohort, count(*) AS n_open, round(avg(CAST(ph OR len(core) = 0 AS INT)), 9) AS excluded
      FROM pairs WHERE open GROUP BY 1) o
JOIN (SELECT cohort, count(*) AS universe, round(avg(CAST(gone AS INT)), 9) AS share_gone,
        round(avg(CAST(closed AS INT)), 9) AS share_closed,
        round(avg(CAST(rotated AS INT)), 9) AS share_rotated, round(avg(target), 9) AS churn
      FROM labelled GROUP BY 1) l ON l.cohort = o.cohort""")
def turnover_by_cohort(spark, d):
    p, v = panel(spark, d), vocabulary(spark, d)
    out = pairs.churn_decomposition(p, pairs.label_pairs(p, v, fuzzy=False), v)
    return out.select(
        "cohort", "n_open", "universe",
        *[F.round(c, 9).alias(c) for c in ("excluded", "share_gone", "share_closed", "share_rotated", "churn")],
    )


@query("churn_spread_across_cohorts", "WITH " + PAIRS_SQL + """
SELECT round(avg(c), 9) AS mean, round(min(c), 9) AS min, round(max(c), 9) AS max, round(stddev_samp(c), 9) AS std
FROM (SELECT cohort, avg(target) AS c FROM labelled GROUP BY 1)""")
def churn_spread_across_cohorts(spark, d):
    per = labelled(spark, d).groupBy("cohort").agg(F.avg("target").alias("c"))
    return rollup.spread(per, "c").select(*[F.round(c, 9).alias(c) for c in ("mean", "min", "max", "std")])


@query("decomposition_counts", "WITH " + PAIRS_SQL + """,
wide AS (
  SELECT cohort, present, open1, norm1, gone, closed,
    present AND norm1 <> '' AND norm1 <> norm AS differs,
    (present AND norm1 <> '' AND norm1 <> norm) AND same_raw AS same
  FROM (SELECT *, NOT present AS gone, present AND NOT open1 AS closed FROM pairs WHERE open AND NOT ph AND len(core) > 0)),
counts AS (
  SELECT cohort, count(*) AS universe, count_if(gone) AS n_gone, count_if(closed) AS n_closed,
    count_if(differs) AS n_differs, count_if(same) AS n_same, count_if(differs AND NOT same) AS n_rotated,
    count_if(gone OR closed OR (differs AND NOT same)) AS n_churn FROM wide GROUP BY 1)
SELECT c.cohort, n_open, n_placeholder, n_generic, CAST(universe AS BIGINT) AS universe,
  CAST(n_gone AS BIGINT) AS n_gone, CAST(n_closed AS BIGINT) AS n_closed, CAST(n_differs AS BIGINT) AS n_differs,
  CAST(n_same AS BIGINT) AS n_same, CAST(n_rotated AS BIGINT) AS n_rotated, CAST(n_churn AS BIGINT) AS n_churn,
  1 AS consistent, round((1 - n_churn / universe) / greatest(n_churn / universe, 1e-9), 6) AS imbalance
FROM counts c JOIN (SELECT cohort, count(*) AS n_open, CAST(count_if(ph) AS BIGINT) AS n_placeholder,
    CAST(count_if(NOT ph AND len(core) = 0) AS BIGINT) AS n_generic FROM pairs WHERE open GROUP BY 1) o ON o.cohort = c.cohort""")
def decomposition_counts(spark, d):
    p, v = panel(spark, d), vocabulary(spark, d)
    lab = pairs.label_pairs(p, v, fuzzy=False, require_open_after=False)
    return pairs.decomposition_report(p, lab, v).withColumn("imbalance", F.round("imbalance", 6))


@query("first_version_churn", "WITH RECURSIVE " + PANEL_SQL + """,
u AS (SELECT a.anio AS cohort, a.norm AS a, b.id IS NULL AS gone, b.id IS NOT NULL AND NOT coalesce(b.open, false) AS closed,
    b.id IS NOT NULL AND coalesce(b.norm, '') <> '' AND a.norm <> coalesce(b.norm, '') AS changed, coalesce(b.norm, '') AS b
  FROM panel a LEFT JOIN panel b ON b.id = a.id AND b.anio = a.anio + 1
  WHERE a.anio + 1 IN (SELECT anio FROM panel) AND a.open AND trim(a.label) <> '')""" + ratio_sql("SELECT a, b FROM u WHERE changed") + """
SELECT cohort, count(*) AS universe, CAST(count_if(gone) AS BIGINT) AS n_gone, CAST(count_if(closed) AS BIGINT) AS n_closed,
  CAST(count_if(changed) AS BIGINT) AS n_changed, CAST(count_if(gone OR closed OR changed) AS BIGINT) AS n_churn,
  CAST(count_if(changed AND coalesce(ratio >= 0.85, false)) AS BIGINT) AS n_similar,
  round((count_if(gone OR closed OR changed) - count_if(changed AND coalesce(ratio >= 0.85, false))) / count(*), 9) AS corrected_churn
FROM u LEFT JOIN ratios r ON r.a = u.a AND r.b = u.b GROUP BY 1""")
def first_version_churn(spark, d):
    return pairs.first_version_report(panel(spark, d)).withColumn("corrected_churn", F.round("corrected_churn", 9))


@query("differ_same_rotated", "WITH " + PAIRS_SQL + """
SELECT cohort, CAST(count_if(differs) AS BIGINT) AS n_differs, CAST(count_if(same) AS BIGINT) AS n_same,
  CAST(count_if(rotated) AS BIGINT) AS n_rotated, CAST(count_if(rotated AND target = 0) AS BIGINT) AS n_outside_target
FROM labelled GROUP BY 1""")
def differ_same_rotated(spark, d):
    return labelled(spark, d).groupBy("cohort").agg(
        F.count_if("differs").alias("n_differs"), F.count_if("same").alias("n_same"),
        F.count_if("rotated").alias("n_rotated"), F.count_if(F.expr("rotated and target = 0")).alias("n_outside_target"),
    )


@query("common_label_share", "WITH " + PANEL_SQL + """
SELECT a.anio AS cohort, count(*) AS n_common, round(avg(CAST(a.norm = b.norm AS INT)), 9) AS identical
FROM panel a JOIN panel b ON a.id = b.id AND b.anio = a.anio + 1 GROUP BY 1""")
def common_label_share(spark, d):
    return pairs.common_label_share(panel(spark, d)).withColumn("identical", F.round("identical", 9))


@query("suspicious_year_pairs", "WITH " + PANEL_SQL + """,
sim AS (SELECT a.anio AS cohort, count(*) AS n_common, avg(CAST(a.norm = b.norm AS INT)) AS identical
  FROM panel a JOIN panel b ON a.id = b.id AND b.anio = a.anio + 1 GROUP BY 1)
SELECT cohort, n_common, round(identical, 9) AS identical, round(m, 9) AS median
FROM sim, (SELECT quantile_cont(identical, 0.5) AS m FROM sim) WHERE identical > m + 0.01""")
def suspicious_year_pairs(spark, d):
    out = pairs.suspicious_pairs(pairs.common_label_share(panel(spark, d)))
    return out.withColumn("identical", F.round("identical", 9)).withColumn("median", F.round("median", 9))


@query("labels_per_id", "WITH " + RAW_SQL + """
SELECT anio, count(*) AS n_ids, CAST(count_if(k > 1) AS BIGINT) AS n_multi,
  round(avg(CAST(k > 1 AS INT)), 9) AS share_multi, max(k) AS max_labels
FROM (SELECT anio, id, count(DISTINCT label) AS k FROM raw GROUP BY 1, 2) GROUP BY 1""")
def labels_per_id(spark, d):
    raw = raw_rows(spark, d).withColumn("norm", normalise("label"))
    return pairs.distinct_label_report(raw, "id", "anio", "norm").withColumn("share_multi", F.round("share_multi", 9))


@query("single_label_ids", "WITH " + RAW_SQL + """
SELECT id FROM (SELECT anio, id FROM raw WHERE anio IN (1996, 1997) GROUP BY 1, 2 HAVING count(DISTINCT label) = 1)
GROUP BY 1 HAVING count(*) = 2""")
def single_label_ids(spark, d):
    raw = raw_rows(spark, d).withColumn("norm", normalise("label"))
    return pairs.single_label_ids(raw, "id", "anio", "norm", (1996, 1997))


@query("multi_label_impact", "WITH " + PAIRS_SQL + "," + RAW_SQL + """,
single AS (SELECT id FROM (SELECT anio, id FROM raw WHERE anio IN (1996, 1997) GROUP BY 1, 2 HAVING count(DISTINCT label) = 1)
  GROUP BY 1 HAVING count(*) = 2),
u AS (SELECT id, CAST(NOT present OR NOT open1 OR norm1 <> norm AS INT) AS churn FROM pairs
  WHERE cohort = 1996 AND open AND norm <> '')
SELECT count(*) AS n_all, round(avg(churn), 9) AS churn_all, count(s.id) AS n_single,
  round(avg(CASE WHEN s.id IS NOT NULL THEN churn END), 9) AS churn_single
FROM u LEFT JOIN single s ON s.id = u.id""")
def multi_label_impact(spark, d):
    raw = raw_rows(spark, d).withColumn("norm", normalise("label"))
    out = pairs.multi_label_impact(panel(spark, d), raw, "id", "anio", "norm", (1996, 1997))
    return out.withColumn("churn_all", F.round("churn_all", 9)).withColumn("churn_single", F.round("churn_single", 9))


def _key_sql(key):
    return "WITH " + PANEL_SQL + f""",
o AS (SELECT id, anio, {key} AS key FROM panel WHERE open)
SELECT a.anio AS cohort, CASE WHEN b.id IS NOT NULL THEN 'survives' WHEN t.id IS NOT NULL THEN 'replaced'
    ELSE 'vanished' END AS outcome, count(*) AS n
FROM o a LEFT JOIN o b ON b.id = a.id AND b.anio = a.anio + 1 AND b.key = a.key
LEFT JOIN panel t ON t.id = a.id AND t.anio = a.anio + 1
WHERE a.anio + 1 IN (SELECT anio FROM panel) GROUP BY 1, 2"""


@query("survival_by_label_key", _key_sql("norm"))
def survival_by_label_key(spark, d):
    return pairs.business_key_report(panel(spark, d), ["norm"])


@query("survival_by_activity_key", _key_sql("activity"))
def survival_by_activity_key(spark, d):
    return pairs.business_key_report(panel(spark, d), ["activity"])


@query("status_only_churn", "WITH " + PAIRS_SQL + """
SELECT cohort, count(*) AS n, CAST(count_if(NOT open1) AS BIGINT) AS n_lost, round(avg(CAST(NOT open1 AS INT)), 9) AS churn
FROM pairs WHERE open GROUP BY 1""")
def status_only_churn(spark, d):
    return pairs.status_only_report(panel(spark, d)).withColumn("churn", F.round("churn", 9))


@query("ids_in_both_years", "WITH " + PANEL_SQL + """
SELECT a.anio, count(*) AS n_common FROM panel a JOIN panel b ON a.id = b.id AND b.anio = a.anio + 1 GROUP BY 1""")
def ids_in_both_years(spark, d):
    return pairs.persistence(panel(spark, d))


@query("literal_label_audit", "WITH " + PAIRS_SQL + """
SELECT cohort, CAST(count_if(norm = 'HOT WIDGET') AS BIGINT) AS n_from,
  CAST(count_if(norm1 = 'HOT WIDGET' AND present) AS BIGINT) AS n_to,
  CAST(count_if(target = 1 AND (norm = 'HOT WIDGET' OR norm1 = 'HOT WIDGET')) AS BIGINT) AS n_in_target,
  round(count_if(target = 1 AND (norm = 'HOT WIDGET' OR norm1 = 'HOT WIDGET')) / count_if(target = 1), 9) AS share_of_target
FROM labelled GROUP BY 1""")
def literal_label_audit(spark, d):
    out = pairs.literal_audit(labelled(spark, d), "HOT WIDGET")
    return out.withColumn("share_of_target", F.round("share_of_target", 9))


@query("exclusion_bias", "WITH " + PANEL_SQL + """,
g AS (SELECT section, count(*) AS n,
    count(*) FILTER (WHERE NOT ph AND len(list_filter(core, lambda w: w NOT IN ('OLD', 'NEW', 'RED'))) = 0) AS e
  FROM panel WHERE open GROUP BY 1)
SELECT section, round(e / t.se - n / t.sn, 9) AS difference FROM g, (SELECT sum(e) AS se, sum(n) AS sn FROM g) t
WHERE e > 0 ORDER BY 2 DESC, 1 LIMIT 3""")
def exclusion_bias(spark, d):
    # three adjectives are added so that some labels are generic
    v = [*vocabulary(spark, d), "OLD", "NEW", "RED"]
    return pairs.exclusion_bias(panel(spark, d), "section", v).withColumn("difference", F.round("difference", 9))


@query("sin_prefix_labels", "WITH " + RAW_SQL + """
SELECT norm, count(*) AS n FROM (SELECT 'SIN ' || label AS norm FROM raw WHERE label <> '') GROUP BY 1""")
def sin_prefix_labels(spark, d):
    raw = raw_rows(spark, d).withColumn("norm", normalise(F.concat(F.lit("Sin "), F.col("label"))))
    return pairs.prefix_counts(raw.where("label <> ''"))


@query("text_signatures_in_rotations", "WITH " + PAIRS_SQL + """
SELECT cohort, count(*) AS n_rotated, CAST(count_if(o % 5 = 0) AS BIGINT) AS n_mojibake,
  CAST(count_if(o % 7 = 0) AS BIGINT) AS n_digit, CAST(count_if(o % 5 = 0 OR o % 7 = 0) AS BIGINT) AS n_any
FROM (SELECT cohort, row_key AS o FROM labelled WHERE rotated) GROUP BY 1""")
def text_signatures_in_rotations(spark, d):
    lab = labelled(spark, d)
    o = F.col("row_key")
    dirty = F.concat(
        "label", F.when(o % 5 == 0, "EspaÃ±a").otherwise(""), F.when(o % 7 == 0, " r0tulo").otherwise("")
    )
    return pairs.text_signatures(lab.withColumn("dirty", dirty), "dirty", "norm1")


@query("history_per_year", "WITH " + HISTORY_SQL + " SELECT * FROM hist")
def history_per_year(spark, d):
    return history.history_as_of(panel(spark, d), vocabulary(spark, d), fuzzy=False)


@query("history_by_increments", "WITH " + HISTORY_SQL + " SELECT * FROM hist")
def history_by_increments(spark, d):
    """Every snapshot meets the stored state once; the state after it, for the ids it holds."""
    p, table_ = panel(spark, d), history.HistoryTable(spark, scratch_path(spark, "history"), vocabulary(spark, d), fuzzy=False)
    out = None
    for year in sorted(r["anio"] for r in p.select("anio").distinct().collect()):  # one row per snapshot
        snapshot = p.where(F.col("anio") == year)
        table_.advance(snapshot, year)
        state = table_.after(snapshot, year)
        out = state if out is None else out.unionByName(state)
    return out


@query("history_fuzzy", "WITH RECURSIVE " + PANEL_SQL + f""",
steps AS (SELECT b.id, b.anio, a.norm AS a, b.norm AS b, coalesce(NOT a.ph AND len(a.core) > 0 AND NOT b.ph AND len(b.core) > 0 AND a.norm <> b.norm
    AND NOT {same_sql("a", "b")}, false) AS open_
  FROM (SELECT id, anio, lag(anio) OVER (PARTITION BY id ORDER BY anio) AS prev FROM panel) l
  JOIN panel b ON b.id = l.id AND b.anio = l.anio LEFT JOIN panel a ON a.id = l.id AND a.anio = l.prev)""" + likely_sql(
    "SELECT a, b FROM steps WHERE open_") + """,
moved AS (SELECT s.id, s.anio, open_ AND k.a IS NULL AS changed FROM steps s LEFT JOIN likely k ON k.a = s.a AND k.b = s.b)
SELECT id, anio, min(anio) OVER w AS first_year, coalesce(max(CASE WHEN changed THEN anio END) OVER w, min(anio) OVER w) AS business_year,
  CAST(sum(CAST(changed AS INT)) OVER w AS BIGINT) AS turnovers
FROM moved WINDOW w AS (PARTITION BY id ORDER BY anio ROWS UNBOUNDED PRECEDING)""")
def history_fuzzy(spark, d):
    return history.history_as_of(panel(spark, d), vocabulary(spark, d), fuzzy=True)


@query("history_window", "WITH " + HISTORY_SQL + """
SELECT id, min(anio) AS first_year, coalesce(max(CASE WHEN c THEN anio END), min(anio)) AS business_year,
  CAST(sum(CAST(c AS INT)) AS BIGINT) AS turnovers
FROM (SELECT *, changed AND lag(anio) OVER (PARTITION BY id ORDER BY anio) >= 1996 AS c FROM obs WHERE anio BETWEEN 1996 AND 1999)
GROUP BY 1""".replace("changed AND lag(anio) OVER (PARTITION BY id ORDER BY anio) >= 1996",
                      "changed AND lag(anio) OVER (PARTITION BY id ORDER BY anio) IS NOT NULL"))
def history_window(spark, d):
    return history.history(panel(spark, d), 1999, 1996, vocabulary(spark, d), fuzzy=False)


@query("history_replicated_windows", "WITH " + HISTORY_SQL + """,
seen AS (SELECT *, lag(anio) OVER (PARTITION BY id ORDER BY anio) AS prev FROM obs)
SELECT cohort, id, min(anio) AS first_year,
  coalesce(max(CASE WHEN changed AND prev >= cohort - 3 THEN anio END), min(anio)) AS business_year,
  CAST(sum(CASE WHEN changed AND prev >= cohort - 3 THEN 1 ELSE 0 END) AS BIGINT) AS turnovers
FROM seen, (SELECT CAST(unnest([1998, 1999, 2000]) AS INT) AS cohort)
WHERE anio BETWEEN cohort - 3 AND cohort GROUP BY 1, 2""")
def history_replicated_windows(spark, d):
    return history.replicated_history(
        panel(spark, d), [1998, 1999, 2000], 3, vocabulary=vocabulary(spark, d), fuzzy=False
    )


@query("derived_ages", "WITH " + HISTORY_SQL + """
SELECT l.id, l.cohort, CAST(l.cohort - business_year AS INT) AS business_age, CAST(l.cohort - first_year AS INT) AS premises_age,
  coalesce(turnovers, 0) AS previous_turnovers,
  CASE WHEN l.cohort > 1995 THEN round(coalesce(turnovers, 0) / (l.cohort - 1995), 9) END AS turnover_rate,
  CAST(coalesce(business_year, 1995) <= 1995 AS INT) AS age_censored
FROM labelled l LEFT JOIN hist h ON h.id = l.id AND h.anio = l.cohort""")
def derived_ages(spark, d):
    p, v = panel(spark, d), vocabulary(spark, d)
    h = history.history_as_of(p, v, fuzzy=False).withColumnRenamed("anio", "cohort")
    u = pairs.label_pairs(p, v, fuzzy=False).select("id", "cohort").join(h, ["id", "cohort"], "left")
    out = history.derived_ages(u, F.col("cohort"), F.lit(1995))
    return out.select("id", "cohort", "business_age", "premises_age", "previous_turnovers",
                      F.round("turnover_rate", 9).alias("turnover_rate"), "age_censored")


@query("brand_features", "WITH " + PANEL_SQL + """,
b AS (SELECT id, anio, mall, array_to_string(core, '|') AS k, length(label) AS label_length,
    CASE WHEN label = '' THEN 0 ELSE len(string_split(label, ' ')) END AS label_words FROM panel),
s AS (SELECT *, CASE WHEN k = '' THEN 1 ELSE count(*) OVER (PARTITION BY anio, k) END AS same_brand,
    CASE WHEN mall IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY anio, mall) END AS mall_size FROM b)
SELECT id, anio, same_brand, CAST(same_brand >= 3 AS INT) AS is_chain, CAST(mall IS NOT NULL AS INT) AS in_mall,
  mall_size, label_length, label_words FROM s""")
def brand_features(spark, d):
    return brand.brand_features(panel(spark, d), vocabulary(spark, d))


@query("top_labels", "WITH " + PANEL_SQL + """
SELECT norm, count(*) AS n, CAST(bool_or(ph) AS INT) AS placeholder FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def top_labels(spark, d):
    from panelflow.operators.clean import placeholder_counts

    return placeholder_counts(panel(spark, d), "norm", 15)


@query("official_vocabulary", "WITH " + PANEL_SQL + """
SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(section || ' ' || activity, '[^A-Z]+', ' ', 'g'), ' ')) AS word FROM panel)
WHERE length(word) > 3""")
def official_vocabulary(spark, d):
    return rollup.official_vocabulary(panel(spark, d), ["section", "activity"])


@query("union_of_yearly_vocabularies", "WITH " + PANEL_SQL + """
SELECT DISTINCT activity AS word FROM panel WHERE length(activity) > 3 AND anio IN (1999, 2000)""")
def union_of_yearly_vocabularies(spark, d):
    p = panel(spark, d)
    return rollup.union_words(
        *[rollup.official_vocabulary(p.where(F.col("anio") == y), ["activity"]) for y in (1999, 2000)]
    )
