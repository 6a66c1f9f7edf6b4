"""Aggregations, cleaning, text, geography, catalogue and income queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions import geo
from panelflow.functions.numbers import decimal_comma, grouped_number
from panelflow.functions.text import (
    LEGAL_FORMS_FIRST_VERSION, match_key, match_key_no_zeros, normalise, place_name, raw_length, search_fold,
    strip_punctuation, word_count,
)
from panelflow.operators import areas, catalogue, clean, evaluate, history, income, ranking, rollup
from panelflow.operators.ordered import rank_buckets
from panelflow.plans.inputs import (
    INCOME_SQL, PAIRS_SQL, RAW_SQL, SCORES_SQL, SNAPSHOTS_SQL, income_rows, panel, raw_rows, scores, snapshots, table,
)
from panelflow.registry.core import query
from panelflow.registry.labelling import FUZZY, labelled
from panelflow.sources import files

SN, RW, SC, PR = "WITH " + SNAPSHOTS_SQL, "WITH " + RAW_SQL, "WITH " + SCORES_SQL, "WITH " + PAIRS_SQL
NATIONS = [f"NATION_{k}" for k in range(25)]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BOX = (440000.0, 442000.0, 4474000.0, 4476500.0)


def r9(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


# ------------------------------------------------------------------ cleaning
@query("keep_first_row", RW + """
SELECT id, anio, row_key, label FROM (SELECT *, row_number() OVER (PARTITION BY id, anio ORDER BY row_key) AS rn FROM raw) WHERE rn = 1""")
def keep_first_row(spark, d):
    return clean.keep_first(raw_rows(spark, d).select("id", "anio", "row_key", "label"), ["id", "anio"], ["row_key"])


NUM = "TRY_CAST(replace(trim({c}), ',', '.') AS DOUBLE)"


@query("decimal_comma_numbers", RW + f" SELECT row_key, {NUM.format(c='x_text')} AS x, {NUM.format(c='y_text')} AS y FROM raw")
def decimal_comma_numbers(spark, d):
    return raw_rows(spark, d).select("row_key", decimal_comma("x_text").alias("x"), decimal_comma("y_text").alias("y"))


@query("valid_coordinates", RW + f""", n AS (SELECT anio, {NUM.format(c='x_text')} AS x, {NUM.format(c='y_text')} AS y FROM raw)
SELECT anio, count(*) AS n, count(*) FILTER (WHERE x > 1000 AND y > 1000) AS n_valid FROM n GROUP BY 1""")
def valid_coordinates(spark, d):
    n = raw_rows(spark, d).select("anio", decimal_comma("x_text").alias("x"), decimal_comma("y_text").alias("y"))
    return n.groupBy("anio").agg(F.count("*").alias("n"), F.count_if(clean.valid_point("x", "y")).alias("n_valid"))


@query("coordinate_quality", RW + f""", n AS (SELECT {NUM.format(c='x_text')} AS x, {NUM.format(c='y_text')} AS y, {NUM.format(c='group_x_text')} AS g FROM raw),
q AS (SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'null' WHEN x = 0 OR y = 0 THEN 'zero'
  WHEN NOT (x BETWEEN {BOX[0]} AND {BOX[1]} AND y BETWEEN {BOX[2]} AND {BOX[3]}) THEN 'outside' ELSE 'valid' END AS quality, g FROM n)
SELECT quality, count(*) AS n, count(*) FILTER (WHERE g > 0 AND quality <> 'valid') AS n_rescued FROM q GROUP BY 1""")
def coordinate_quality(spark, d):
    return clean.coordinate_quality(raw_rows(spark, d), "x_text", "y_text", "group_x_text", BOX)


@query("open_flag", RW + " SELECT row_key, CAST(contains(upper(situation), 'ABIERT') AS INT) AS is_open FROM raw")
def open_flag(spark, d):
    return raw_rows(spark, d).select("row_key", clean.open_flag("situation").cast("int").alias("is_open"))


@query("interior_excluded", RW + """
SELECT anio, count(*) AS n, count(*) FILTER (WHERE upper(trim(access)) = 'INTERIOR') AS n_interior,
  round(avg(CAST(coalesce(upper(trim(access)) = 'INTERIOR', false) AS INT)), 9) AS share_interior FROM raw GROUP BY 1""")
def interior_excluded(spark, d):
    return r9(clean.interior_report(raw_rows(spark, d), "access", "anio"), "share_interior")


@query("clean_panel", RW + """,
f AS (SELECT *, row_number() OVER (PARTITION BY id, anio ORDER BY row_key) AS rn FROM raw)
SELECT id, anio, label AS norm, CAST(contains(upper(situation), 'ABIERT') AS INT) AS is_open, trim(situation) AS situation
FROM f WHERE rn = 1 AND NOT coalesce(upper(trim(access)) = 'INTERIOR', false)""")
def clean_panel(spark, d):
    p = clean.clean_panel(raw_rows(spark, d), ["id", "anio"], ["row_key"])
    return clean.trim_text(p, ["situation"]).select("id", "anio", "norm", F.col("open").cast("int").alias("is_open"), "situation")


@query("status_groups", RW + """,
g AS (SELECT anio, CASE WHEN contains(lower(situation), 'abiert') THEN 'open' WHEN contains(lower(situation), 'cerrad') THEN 'closed'
  WHEN contains(lower(situation), 'vivienda') OR contains(lower(situation), 'obra') THEN 'housing or works' ELSE 'dropped or other' END AS state FROM raw)
SELECT anio, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY anio), 9) AS share FROM g GROUP BY 1, 2""")
def status_groups(spark, d):
    return r9(clean.status_shares(raw_rows(spark, d), "situation", "anio"), "share")


LQ = """SELECT {g}, count(*) AS n, count(*) FILTER (WHERE trim(v) = '') AS n_empty, count(*) FILTER (WHERE regexp_matches(v, '[ÁÉÍÓÚÑáéíóúñ]')) AS n_accented,
  count(*) FILTER (WHERE regexp_matches(v, 'Ã|Â|â€|Ãƒ|ï¿½')) AS n_mojibake,
  count(*) FILTER (WHERE regexp_matches(upper(v), '[A-Z][0-9][A-Z]')) AS n_digit_in_word,
  count(*) FILTER (WHERE regexp_matches(NORM, '[A-Z]0[A-Z]|0N\\b')) AS n_ocr FROM {t} GROUP BY 1"""
NORM_NODIGIT = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(upper(replace(v, 'ß', 'ss'))), '[^\p{L}\p{N}_]+', ' ', 'g'), '\b(S\s*L\s*U|S\s*L|S\s*A\s*U|S\s*A|C\s*B|S\s*C)\b', ' ', 'g'), ' +', ' ', 'g'))"


@query("label_quality", LQ.format(g="lang", t="(SELECT lang, text AS v FROM documents)").replace("NORM", NORM_NODIGIT))
def label_quality(spark, d):
    return clean.label_quality(table(spark, d, "documents"), "text", "lang")


@query("training_range_clipping", SN + """,
r AS (SELECT min(x) AS lo, max(x) AS hi FROM snaps WHERE anio <= 1997 AND id % 3 = 0)
SELECT id, anio, least(greatest(x, lo), hi) AS x, CASE WHEN x < lo OR x > hi THEN 'x' ELSE '' END AS warnings FROM snaps, r""")
def training_range_clipping(spark, d):
    s = snapshots(spark, d)
    ranges = clean.training_ranges(s.where("anio <= 1997 and id % 3 = 0"), ["x"])
    out = clean.clip_to_ranges(s.select("id", "anio", "x"), ranges, ["x"])
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("clip_counts", SN + """,
r AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM snaps WHERE anio <= 1997 AND id % 3 = 0)
SELECT 'x' AS variable, max(lx) AS lo, max(hx) AS hi, count(*) FILTER (WHERE x < lx) AS n_low, count(*) FILTER (WHERE x > hx) AS n_high FROM snaps, r
UNION ALL SELECT 'y', max(ly), max(hy), count(*) FILTER (WHERE y < ly), count(*) FILTER (WHERE y > hy) FROM snaps, r""")
def clip_counts(spark, d):
    s = snapshots(spark, d)
    return clean.clip_report(s, clean.training_ranges(s.where("anio <= 1997 and id % 3 = 0"), ["x", "y"]), ["x", "y"])


@query("null_defaults", SN + """
SELECT anio, CAST(sum(CASE WHEN mall IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS in_mall FROM snaps GROUP BY 1""")
def null_defaults(spark, d):
    s = snapshots(spark, d).withColumn("k", F.when(F.col("mall").isNotNull(), F.lit(1)))
    return clean.fill_defaults(s, ["k"]).groupBy("anio").agg(F.sum("k").alias("in_mall"))


@query("category_remap", """WITH t AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS c FROM supplier WHERE s_suppkey % 2 = 0),
p AS (SELECT l_orderkey, l_linenumber, ' ' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(t.c, v) AS v, CAST(t.c IS NULL AS INT) AS unmatched
FROM p LEFT JOIN t ON t.c = coalesce(nullif(ltrim(trim(v), '0'), ''), '0')""")
def category_remap(spark, d):
    train = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("v"))
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("v")
    )
    out = clean.remap_categories(li, clean.canonical_values(train, "v"), "v")
    return out.select("l_orderkey", "l_linenumber", "v", F.col("v_unmatched").cast("int").alias("unmatched"))


@query("unmatched_category_share", """SELECT round(avg(CAST(l_suppkey % 2 = 1 AS INT)), 9) AS share FROM lineitem""")
def unmatched_category_share(spark, d):
    train = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("v"))
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("v"))
    out = clean.remap_categories(li, clean.canonical_values(train, "v"), "v")
    return out.agg(F.round(F.avg(F.col("v_unmatched").cast("double")), 9).alias("share"))


@query("code_catalogue", """
WITH t AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderpriority ELSE CAST(o_custkey % 40 AS VARCHAR) END AS code,
  CASE WHEN o_custkey % 40 = 7 THEN '' ELSE ' ' || o_orderpriority END AS dsc FROM orders),
c AS (SELECT code, trim(dsc) AS dsc, count(*) AS n FROM t WHERE regexp_full_match(code, '[0-9]+') GROUP BY ALL),
m AS (SELECT code, dsc, row_number() OVER (PARTITION BY code ORDER BY n DESC, dsc) AS rn FROM c WHERE dsc <> '')
SELECT k.code, coalesce(m.dsc, k.code || ' (no description)') AS description
FROM (SELECT DISTINCT code FROM c) k LEFT JOIN m ON m.code = k.code AND m.rn = 1""")
def code_catalogue(spark, d):
    o = table(spark, d, "orders")
    t = o.select(
        F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderpriority")).otherwise((F.col("o_custkey") % 40).cast("string")).alias("c"),
        F.when(F.col("o_custkey") % 40 == 7, "").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("dsc"),
    )
    return catalogue.code_catalogue(t, "c", "dsc")


@query("constant_features_dropped", SN + " SELECT anio, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx FROM snaps GROUP BY 1")
def constant_features_dropped(spark, d):
    s = snapshots(spark, d).select("anio", "x", F.lit(1).alias("always"))
    kept = clean.drop_constant(s, s, ["x", "always"])
    return kept.groupBy("anio").agg(F.count("*").alias("n"), *[F.sum(c).alias("s" + c) for c in kept.columns if c != "anio"])


@query("codes_of_reference_year", SN + """
SELECT anio, count(*) AS n FROM snaps WHERE barrio IN (SELECT barrio FROM snaps WHERE anio = 2001) GROUP BY 1""")
def codes_of_reference_year(spark, d):
    return clean.codes_of_reference_year(snapshots(spark, d), "barrio", "anio", 2001).groupBy("anio").agg(F.count("*").alias("n"))


@query("district_activity_filter", SN + """
SELECT id, anio, label FROM snaps WHERE upper(trim(district)) = 'NATION_3' AND contains(upper(trim(activity)), 'WID')""")
def district_activity_filter(spark, d):
    return clean.text_filter(snapshots(spark, d), "district", " nation_3 ", "activity", "wid").select("id", "anio", "label")


# ---------------------------------------------------------------------- text
NORM_SQL = """array_to_string(list_transform(string_split(NN, ' '), lambda w: CASE WHEN regexp_matches(w, '\\p{L}')
  THEN translate(w, '01', 'OI') ELSE w END), ' ')"""


def norm_sql(v):
    return NORM_SQL.replace("NN", NORM_NODIGIT.replace("(v,", f"({v},"))


@query("normalised_labels", f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5 FROM documents")
def normalised_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalise("text")).alias("norm_md5"))


@query("normalised_page_addresses", f"SELECT page_id, {norm_sql('url')} AS norm FROM pages")
def normalised_page_addresses(spark, d):
    return table(spark, d, "pages").select("page_id", normalise("url").alias("norm"))


@query("normalised_first_version",
       "SELECT doc_id, md5(" + NORM_NODIGIT.replace("(v,", "(text,").replace("|S\\s*C)", "|S\\s*C|SOCIEDAD LIMITADA|SOCIEDAD ANONIMA)") + ") AS norm_md5 FROM documents")
def normalised_first_version(spark, d):
    n = normalise("text", digits=False, legal_forms=LEGAL_FORMS_FIRST_VERSION)
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("norm_md5"))


@query("search_folded_text", "SELECT doc_id, md5(strip_accents(upper(replace(trim(text), 'ß', 'ss')))) AS folded FROM documents")
def search_folded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(search_fold("text")).alias("folded"))


@query("stripped_punctuation", r"SELECT page_id, trim(regexp_replace(lower(url), '[^\p{L}\p{N}_\s]', '', 'g')) AS stripped FROM pages")
def stripped_punctuation(spark, d):
    return table(spark, d, "pages").select("page_id", strip_punctuation("url").alias("stripped"))


@query("label_size", f"""SELECT doc_id, length(text) AS label_length,
  CASE WHEN {norm_sql('text')} = '' THEN 0 ELSE len(string_split({norm_sql('text')}, ' ')) END AS label_words FROM documents""")
def label_size(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", raw_length("text").alias("label_length"), word_count(normalise("text")).alias("label_words")
    )


@query("match_keys", """SELECT DISTINCT v, upper(trim(v)) AS key1, coalesce(nullif(ltrim(upper(trim(v)), '0'), ''), '0') AS key2
FROM (SELECT ' 00' || CAST(l_suppkey AS VARCHAR) || ' ' AS v FROM lineitem UNION ALL SELECT '000' FROM region)""")
def match_keys(spark, d):
    v = table(spark, d, "lineitem").select(F.concat(F.lit(" 00"), F.col("l_suppkey").cast("string"), F.lit(" ")).alias("v"))
    v = v.unionByName(table(spark, d, "region").select(F.lit("000").alias("v"))).distinct()
    return v.select("v", match_key("v").alias("key1"), match_key_no_zeros("v").alias("key2"))


@query("place_names", """SELECT DISTINCT upper(left(p_name, 1)) || split_part(substr(p_name, 2), ' ', 1) || ' ' ||
  upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) || ' (' || left(p_type, 1) || lower(substr(p_type, 2)) || ')' AS place FROM part""")
def place_names(spark, d):
    return table(spark, d, "part").select(place_name("p_name", "p_type").alias("place")).distinct()


# -------------------------------------------------------------------- rollups
@query("yearly_volume", SN + """
SELECT anio, count(*) AS n, count(*) FILTER (WHERE open) AS n_open, round(avg(CAST(open AS INT)), 9) AS share_open,
  round(n_open / lag(n_open) OVER (ORDER BY anio) - 1, 9) AS change FROM snaps GROUP BY anio""")
def yearly_volume(spark, d):
    v = rollup.yearly_volume(snapshots(spark, d), "anio", "open")
    return r9(history.year_on_year(v, "anio", "n_open", "change"), "share_open", "change")


@query("size_sum_mean", PR + """
SELECT cohort, district, count(*) AS n, CAST(sum(target) AS BIGINT) AS hits, round(avg(target), 9) AS rate FROM labelled GROUP BY 1, 2""")
def size_sum_mean(spark, d):
    return r9(rollup.size_sum_mean(labelled(spark, d), ["cohort", "district"]), "rate")


@query("size_sum_mean_with_totals", PR + """
SELECT CAST(cohort AS VARCHAR) AS cohort, district, count(*) AS n, CAST(sum(target) AS BIGINT) AS hits, round(avg(target), 9) AS rate FROM labelled GROUP BY ROLLUP (cohort, district)""")
def size_sum_mean_with_totals(spark, d):
    return r9(rollup.size_sum_mean(labelled(spark, d), ["cohort", "district"], grand_totals=True).withColumn("cohort", F.col("cohort").cast("string")), "rate")


@query("rate_by_bins", SC + """
SELECT CASE WHEN p2 <= 0 THEN NULL WHEN p2 <= 0.25 THEN 1 WHEN p2 <= 0.5 THEN 2 WHEN p2 <= 0.75 THEN 3 ELSE 4 END AS bin,
 count(*) AS n, round(avg(y), 9) AS rate FROM scores WHERE p2 > 0 AND p2 <= 1 GROUP BY 1""")
def rate_by_bins(spark, d):
    return r9(rollup.rate_by_bins(scores(spark, d), "p2", (0, 0.25, 0.5, 0.75, 1.0), "y"), "rate")


@query("rate_by_clipped_value", PR + """
SELECT least(id % 9, 3) AS value, count(*) AS n, round(avg(target), 9) AS rate FROM labelled GROUP BY 1""")
def rate_by_clipped_value(spark, d):
    return r9(rollup.rate_by_clipped(labelled(spark, d).withColumn("k", F.col("id") % 9), "k", 3), "rate")


@query("modal_division", SN + """
SELECT barrio, division FROM (SELECT barrio, division, row_number() OVER (PARTITION BY barrio ORDER BY count(*) DESC, division) AS rn
FROM snaps WHERE division IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def modal_division(spark, d):
    return rollup.mode_per_group(snapshots(spark, d), ["barrio"], "division")


@query("modal_parent_with_default", SN + """,
m AS (SELECT activity, division FROM (SELECT activity, division, row_number() OVER (PARTITION BY activity ORDER BY count(*) DESC, division) AS rn
  FROM snaps WHERE division IS NOT NULL AND activity <> 'ROD' GROUP BY 1, 2) WHERE rn = 1)
SELECT a.activity, coalesce(division, '56') AS division FROM (SELECT DISTINCT activity FROM snaps) a LEFT JOIN m ON m.activity = a.activity""")
def modal_parent_with_default(spark, d):
    s = snapshots(spark, d)
    parents = catalogue.modal_parent(s.where("activity <> 'ROD'"), "activity", "division")
    return catalogue.with_parent(s.select("activity").distinct(), parents, "activity", "division")


@query("rollup_with_minimum_support", SC + """
SELECT g, h, count(*) AS n, round(avg(p), 9) AS mean_risk, max(p) AS max_risk FROM scores GROUP BY 1, 2 HAVING count(*) >= 5""")
def rollup_with_minimum_support(spark, d):
    return r9(rollup.with_min_support(scores(spark, d), ["g", "h"], "p", 5), "mean_risk")


AREA = SN + """,
r AS (SELECT *, ROUNDP AS p FROM snaps WHERE anio = 1999),
q AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rn, count(*) OVER () AS n FROM r),
z AS (SELECT *, CAST(greatest(1, ceil((rn - 1) * 10 / (n - 1))) AS INT) AS decile FROM q)""".replace("ROUNDP", "round((id * 17 % 101) / 101.0::DOUBLE, 4)")


def _scored_snapshot(spark, d):
    s = snapshots(spark, d).where("anio = 1999").withColumn("p", F.round((F.col("id") * 17 % 101) / F.lit(101.0), 4))
    return rank_buckets(s, "p", "id")


def _half_even(x, n):
    """SQL of ``round_half_even``."""
    v = f"(CAST(round({x}, 12) AS DECIMAL(28, 12)) * CAST({10**n} AS DECIMAL(8, 0)))"
    up = f"({v} - floor({v}) > 0.5 OR ({v} - floor({v}) = 0.5 AND CAST(floor({v}) AS BIGINT) % 2 = 1))"
    return f"CAST(floor({v}) + CAST({up} AS INT) AS DOUBLE) / {10**n}"


@query("area_rollup", AREA + f""",
g AS (SELECT district, barrio, count(*) AS n, avg(p) AS a, max(p) AS b, 100 * avg(CAST(decile = 10 AS INT)) AS c, avg(x) AS d, avg(y) AS e, count(x) AS m FROM z GROUP BY 1, 2)
SELECT district, barrio, n, {_half_even('a', 5)} AS mean_risk, {_half_even('b', 5)} AS max_risk, {_half_even('c', 2)} AS pct_decile_10,
  {_half_even('d', 6)} AS lon, {_half_even('e', 6)} AS lat, m AS n_with_coordinates FROM g""")
def area_rollup(spark, d):
    return rollup.area_rollup(_scored_snapshot(spark, d), ["district", "barrio"])


@query("section_shares_by_barrio", SN + "\nSELECT barrio, " + ", ".join(
    f"round(count(*) FILTER (WHERE division = '{v}') / count(*), 9) AS mix_{v.lower()}" for v in SEGMENTS)
    + " FROM snaps WHERE open AND division IS NOT NULL GROUP BY 1")
def section_shares_by_barrio(spark, d):
    out = rollup.wide_composition(rollup.composition(snapshots(spark, d).where("open"), ["barrio"], "division"), ["barrio"], "division")
    return r9(out, *[c for c in out.columns if c.startswith("mix_")])


@query("counts_long_to_wide", SN + "\nSELECT anio, " + ", ".join(f"count(*) FILTER (WHERE division = '{v}') AS {v}" for v in SEGMENTS)
       + " FROM snaps GROUP BY 1")
def counts_long_to_wide(spark, d):
    return rollup.count_pivot(snapshots(spark, d), ["anio"], "division", SEGMENTS)


@query("rate_pivot", PR + ",\ntop AS (SELECT activity FROM labelled GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)\nSELECT activity, "
       + ", ".join(f"round(avg(target) FILTER (WHERE district = '{v}'), 9) AS {v}" for v in NATIONS)
       + " FROM labelled WHERE activity IN (SELECT activity FROM top) GROUP BY 1")
def rate_pivot(spark, d):
    return r9(rollup.rate_pivot(labelled(spark, d), "activity", "district", NATIONS), *NATIONS)


@query("area_year_features", SN + """
SELECT barrio, anio, count(*) AS n_listed, count(*) FILTER (WHERE open) AS n_open,
  round(1 - count(*) FILTER (WHERE open) / count(*), 9) AS share_closed FROM snaps GROUP BY 1, 2""")
def area_year_features(spark, d):
    return r9(rollup.area_features(snapshots(spark, d), ["barrio", "anio"]), "share_closed")


@query("crosstab", SN + " SELECT division, access, count(*) AS n FROM snaps GROUP BY 1, 2")
def crosstab(spark, d):
    return rollup.crosstab(snapshots(spark, d), "division", "access")


@query("correlations", SC + """
SELECT 'p' AS a, 'p2' AS b, round(corr(p, p2), 9) AS r FROM scores UNION ALL SELECT 'p', 'y', round(corr(p, y), 9) FROM scores
UNION ALL SELECT 'p2', 'y', round(corr(p2, y), 9) FROM scores""")
def correlations(spark, d):
    return r9(rollup.correlations(scores(spark, d), ["p", "p2", "y"]), "r")


@query("agreement", SC + " SELECT count(*) AS n, count(*) FILTER (WHERE y = y2) AS n_equal, round(corr(y, y2), 9) AS r FROM scores")
def agreement(spark, d):
    return r9(rollup.agreement(scores(spark, d), "y", "y2"), "r")


@query("concentration", SN + """,
g AS (SELECT district, count(*) AS n FROM snaps GROUP BY 1)
SELECT district, n, CAST(row_number() OVER w AS INT) AS rank, round(sum(n) OVER w / (SELECT sum(n) FROM g), 9) AS cum_share
FROM g WINDOW w AS (ORDER BY n DESC, district ROWS UNBOUNDED PRECEDING)""")
def concentration(spark, d):
    return r9(rollup.concentration(snapshots(spark, d), "district"), "cum_share")


@query("top_five_share", SN + """,
g AS (SELECT district, count(*) AS n FROM snaps GROUP BY 1)
SELECT CAST(count(*) AS INT) AS k, round(sum(n) / (SELECT sum(n) FROM g), 9) AS share FROM (SELECT n FROM g ORDER BY n DESC, district LIMIT 5)""")
def top_five_share(spark, d):
    return r9(rollup.top_share(snapshots(spark, d), "district", 5), "share")


@query("long_tail", SN + """,
g AS (SELECT barrio, count(*) AS n FROM snaps GROUP BY 1)
SELECT count(*) AS n_categories, count(*) FILTER (WHERE n / (SELECT sum(n) FROM g) >= 0.01) AS n_common, count(*) FILTER (WHERE n <= 20) AS n_tail FROM g""")
def long_tail(spark, d):
    return rollup.long_tail(snapshots(spark, d), "barrio")


@query("cardinalities", SN + """
SELECT 'district' AS column, count(DISTINCT district) AS n_distinct FROM snaps UNION ALL SELECT 'barrio', count(DISTINCT barrio) FROM snaps
UNION ALL SELECT 'division', count(DISTINCT division) FROM snaps UNION ALL SELECT 'label', count(DISTINCT label) FROM snaps""")
def cardinalities(spark, d):
    return rollup.cardinalities(snapshots(spark, d), ["district", "barrio", "division", "label"])


@query("class_balance", PR + """
SELECT count(*) AS n, CAST(sum(target) AS BIGINT) AS hits, round(avg(target), 9) AS rate, round((count(*) - sum(target)) / sum(target), 9) AS imbalance FROM labelled""")
def class_balance(spark, d):
    return r9(rollup.class_balance(labelled(spark, d)), "rate", "imbalance")


@query("field_coverage", RW + f"""
SELECT anio, round(avg(CAST(coalesce({NUM.format(c='x_text')} > 1000, false) AS INT)), 9) AS coordinate,
  round(avg(CAST(trim(label) <> '' AS INT)), 9) AS label, round(avg(CAST(access IS NOT NULL AS INT)), 9) AS access FROM raw GROUP BY 1""")
def field_coverage(spark, d):
    out = rollup.coverage(
        raw_rows(spark, d), "anio",
        {"coordinate": decimal_comma("x_text") > 1000, "label": F.trim("label") != "", "access": F.col("access").isNotNull()},
    )
    return r9(out, "coordinate", "label", "access")


@query("predicted_minus_observed", SC + """
SELECT h, count(*) AS n, round(avg(y), 9) AS observed, round(avg(p), 9) AS predicted, round(avg(p) - avg(y), 9) AS error FROM scores GROUP BY 1""")
def predicted_minus_observed(spark, d):
    return r9(rollup.error_rollup(scores(spark, d), "h"), "observed", "predicted", "error")


@query("pooled_observed_predicted", SC + """
SELECT h, count(*) AS n, round(avg(y), 9) AS observed, round(avg(p), 9) AS predicted FROM scores WHERE h <> 'src0' GROUP BY 1""")
def pooled_observed_predicted(spark, d):
    return r9(rollup.pooled_observed_predicted(scores(spark, d), "h", "SRC0"), "observed", "predicted")


WIDE = {"test": {"n": "n_test", "hits": "hits_test"}, "later": {"n": "n_later", "hits": "hits_later"}}


def _wide(spark, d):
    return scores(spark, d).groupBy("h").agg(
        F.count_if(F.expr("g = 'en'")).alias("n_test"), F.count_if(F.expr("g <> 'en'")).alias("n_later"),
        F.count_if(F.expr("g = 'en' and y = 1")).alias("hits_test"), F.count_if(F.expr("g <> 'en' and y = 1")).alias("hits_later"),
    )


@query("wide_to_long", SC + """
SELECT h, CASE WHEN e.x THEN 'test' ELSE 'later' END AS block, count(*) FILTER (WHERE (g = 'en') = x) AS n,
  count(*) FILTER (WHERE (g = 'en') = x AND y = 1) AS hits FROM scores, (SELECT true AS x UNION ALL SELECT false) e GROUP BY 1, 2""")
def wide_to_long(spark, d):
    return rollup.wide_to_long(_wide(spark, d), "h", WIDE, "block")


@query("long_equals_wide", "SELECT 0::BIGINT AS mismatches")
def long_equals_wide(spark, d):
    w = _wide(spark, d)
    return rollup.long_matches_wide(rollup.wide_to_long(w, "h", WIDE, "block"), w, "h", WIDE, "block")


@query("union_of_years", SN + " SELECT id, anio, label FROM snaps")
def union_of_years(spark, d):
    s = snapshots(spark, d).select("id", "anio", "label")
    years = [s.where(F.col("anio") == y) for y in range(1995, 2002)]
    return reduce(DataFrame.unionByName, years)


@query("top_groups_in_context", SC + """
SELECT h, round(avg(p), 9) AS mean, count(*) AS n FROM scores WHERE g = 'en' GROUP BY 1 ORDER BY avg(p) DESC, h LIMIT 5""")
def top_groups_in_context(spark, d):
    return r9(ranking.top_groups(scores(spark, d), {"g": "en"}, "h", "p", 5), "mean")


@query("search_labels", """SELECT doc_id AS id, n_chars / 1000 AS p FROM documents
WHERE contains(strip_accents(upper(replace(text, 'ß', 'ss'))), 'TION') AND upper(source) = 'SRC3' ORDER BY n_chars DESC, doc_id LIMIT 20""")
def search_labels(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("label"), F.col("source").alias("barrio"), (F.col("n_chars") / 1000).alias("p")
    )
    return ranking.search(docs, "tión", "src3").select("id", "p")


@query("lookup_ids", """SELECT a.l_suppkey AS id, s_name, CAST(s_name IS NOT NULL AS INT) AS found
FROM (SELECT DISTINCT l_suppkey * 2 AS l_suppkey FROM lineitem) a LEFT JOIN supplier ON s_suppkey = a.l_suppkey""")
def lookup_ids(spark, d):
    wanted = table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("id"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return ranking.lookup(known, wanted, "id")


@query("sorted_export", SC + " SELECT h, count(*) AS n FROM scores GROUP BY 1")
def sorted_export(spark, d):
    return ranking.sorted_export(rollup.tie_groups(scores(spark, d), "h"), [F.desc("n"), "h"])


@query("attribute_lookup", """SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10""")
def attribute_lookup(spark, d):
    part = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.join(part, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_brand", "p_type")


@query("hits_with_destination", PR + """
SELECT id, cohort, norm, CASE WHEN present THEN norm1 ELSE '(gone)' END AS destination FROM labelled
WHERE target = 1 ORDER BY id * 17 % 101 DESC, id * 100000 + cohort LIMIT 20""")
def hits_with_destination(spark, d):
    lab = labelled(spark, d).withColumn("p", F.col("id") * 17 % 101).withColumn("k", F.col("id") * 100000 + F.col("cohort"))
    return ranking.hits_with_destination(lab, "p", "k", 20, "norm1").select("id", "cohort", "norm", "destination")


KEYED = """, keyed AS (SELECT CAST(id AS VARCHAR) || '-' || CAST(cohort AS VARCHAR) AS k, norm, norm1, rotated, differs, same FROM labelled)"""


@query("changed_label_sample", PR + KEYED + " SELECT k, norm, norm1 FROM keyed WHERE differs ORDER BY md5(k || '-7'), k LIMIT 25")
def changed_label_sample(spark, d):
    lab = labelled(spark, d).where("differs").withColumn("k", F.concat_ws("-", "id", "cohort"))
    return ranking.stable_sample(lab.select("k", "norm", "norm1"), 25, "k", 7)


def _review(spark, d, fuzzy):
    lab = labelled(spark, d, fuzzy=fuzzy).withColumn("k", F.concat_ws("-", "id", "cohort")).select("k", "norm", "norm1", "rotated", "differs", "same")
    pos = ranking.stable_sample(lab.where("rotated"), 40, "k", 2024).select("k", "norm", "norm1", F.lit("positive").alias("kind"))
    neg = ranking.stable_sample(lab.where("differs and same"), 25, "k", 2024).select("k", "norm", "norm1", F.lit("discarded").alias("kind"))
    return pos.unionByName(neg)


@query("review_samples", FUZZY + """,
keyed AS (SELECT CAST(id AS VARCHAR) || '-' || CAST(cohort AS VARCHAR) AS k, norm, norm1, rot, differs FROM fuzzy),
p AS (SELECT k, norm, norm1, 'positive' AS kind FROM keyed WHERE rot ORDER BY md5(k || '-2024'), k LIMIT 40),
n AS (SELECT k, norm, norm1, 'discarded' AS kind FROM keyed WHERE differs AND NOT rot ORDER BY md5(k || '-2024'), k LIMIT 25)
SELECT * FROM p UNION ALL SELECT * FROM n""")
def review_samples(spark, d):
    return _review(spark, d, True)


@query("review_samples_exact", PR + KEYED + """,
p AS (SELECT k, norm, norm1, 'positive' AS kind FROM keyed WHERE rotated ORDER BY md5(k || '-2024'), k LIMIT 40),
n AS (SELECT k, norm, norm1, 'discarded' AS kind FROM keyed WHERE differs AND same ORDER BY md5(k || '-2024'), k LIMIT 25)
SELECT * FROM p UNION ALL SELECT * FROM n""")
def review_samples_exact(spark, d):
    return _review(spark, d, False)


# ------------------------------------------------------------------ geography
LON, LAT = geo.lon_lat_sql("x", "y")


@query("longitude_latitude", SN + f" SELECT id, anio, round({LON}, 7) AS lon, round({LAT}, 7) AS lat FROM snaps")
def longitude_latitude(spark, d):
    out = geo.with_lon_lat(snapshots(spark, d))
    return out.select("id", "anio", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("share_inside_box", SN + f""" SELECT count(*) AS n, round(avg(CAST({LON} BETWEEN -3.71 AND -3.69 AND {LAT} BETWEEN 40.40 AND 40.44 AS INT)), 9) AS share_inside,
  CAST(avg(CAST({LON} BETWEEN -3.71 AND -3.69 AND {LAT} BETWEEN 40.40 AND 40.44 AS INT)) >= 0.98 AS INT) AS ok FROM snaps""")
def share_inside_box(spark, d):
    return r9(geo.share_in_box(geo.with_lon_lat(snapshots(spark, d)), "lon", "lat", (-3.71, -3.69, 40.40, 40.44)), "share_inside")


@query("hull_area_by_district")
def hull_area_by_district(spark, d):
    return areas.hull_areas(snapshots(spark, d), "district")


# ------------------------------------------------------- sources as operators
@query("schema_audit", """WITH h AS (SELECT DISTINCT 'f' || CAST(year(o_orderdate) AS VARCHAR) AS file, o_orderpriority AS col FROM orders
  WHERE NOT (o_orderpriority = '5-LOW' AND year(o_orderdate) = 1997)),
w AS (SELECT '1-URGENT' AS col, 1 AS required UNION ALL SELECT '5-LOW', 0 UNION ALL SELECT '2-HIGH', 0 UNION ALL SELECT 'ABSENT', 0)
SELECT w.col AS column, required, count(DISTINCT file) AS n_files, (SELECT count(DISTINCT file) FROM h) - count(DISTINCT file) AS n_missing,
  CAST(required = 1 OR count(DISTINCT file) = (SELECT count(DISTINCT file) FROM h) AS INT) AS usable FROM w LEFT JOIN h ON h.col = w.col GROUP BY 1, 2""")
def schema_audit(spark, d):
    o = table(spark, d, "orders")
    year = F.year("o_orderdate")
    headers = o.where(~((F.col("o_orderpriority") == "5-LOW") & (year == 1997))).select(
        F.concat(F.lit("f"), year.cast("string")).alias("file"), F.col("o_orderpriority").alias("column")
    ).distinct()
    return files.schema_audit(headers, ["1-URGENT"], ["5-LOW", "2-HIGH", "ABSENT"])


MONTH_SQL = "CASE month(o_orderdate) " + " ".join(f"WHEN {k} THEN '{m.title()}'" for k, m in enumerate(files.MONTHS, 1)) + " END"


@query("catalogue_descriptions", """SELECT DISTINCT 'actividades' AS kind, CAST(year(o_orderdate) AS INT) AS anio, CAST(month(o_orderdate) AS INT) AS mes FROM orders""")
def catalogue_descriptions(spark, d):
    return _catalogue(spark, d).select("kind", "anio", "mes")


def _catalogue(spark, d):
    months = F.array(*[F.lit(m.title()) for m in files.MONTHS])
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("Actividades. "), F.element_at(months, F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate").cast("string")).alias("description")
    ).distinct().withColumn("url", F.lit("")).withColumn("bytes", F.lit(1e6))
    return files.catalogue_from_descriptions(rows)


@query("catalogue_availability", """SELECT anio, string_agg(CAST(mes AS VARCHAR), ',' ORDER BY mes) AS months FROM
 (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS anio, CAST(month(o_orderdate) AS INT) AS mes FROM orders) GROUP BY 1""")
def catalogue_availability(spark, d):
    return files.availability(_catalogue(spark, d))


@query("review_state", """SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_empty, count(*) FILTER (WHERE doc_id % 10 = 1) AS n_bad,
  count(*) FILTER (WHERE doc_id % 10 > 1 AND toxic = 1) AS n_yes FROM labels""")
def review_state(spark, d):
    v = F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 10 == 1, "maybe").otherwise(F.col("toxic").cast("double").cast("string"))
    return files.review_state(table(spark, d, "labels").withColumn("verdict", v), "verdict")


@query("cohort_summary_counts", PR + """
SELECT count(*) AS universe, CAST(sum(target) AS BIGINT) AS churn, count(*) FILTER (WHERE rotated) AS rotated, count(*) FILTER (WHERE same) AS discarded FROM labelled WHERE cohort = 1997""")
def cohort_summary_counts(spark, d):
    return _counts(spark, d)


def _counts(spark, d):
    return labelled(spark, d).where("cohort = 1997").agg(
        F.count("*").alias("universe"), F.sum("target").alias("churn"), F.count_if("rotated").alias("rotated"), F.count_if("same").alias("discarded")
    )


@query("label_error_correction", PR + """,
c AS (SELECT count(*) AS u, sum(target) AS b, count(*) FILTER (WHERE rotated) AS r, count(*) FILTER (WHERE same) AS d FROM labelled WHERE cohort = 1997),
w AS (SELECT k, n, k / n AS p, z, (k/n + z*z/(2*n)) / (1 + z*z/n) AS ce, z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n) AS hw
  FROM (SELECT 1.0::DOUBLE AS k, 40.0::DOUBLE AS n, 1.959963984540054::DOUBLE AS z UNION ALL SELECT 8.0, 25.0, 1.959963984540054)),
e AS (SELECT max(p) FILTER (WHERE n = 40) AS fp, max(ce - hw) FILTER (WHERE n = 40) AS fpl, max(ce + hw) FILTER (WHERE n = 40) AS fph,
  max(p) FILTER (WHERE n = 25) AS fn, max(ce - hw) FILTER (WHERE n = 25) AS fnl, max(ce + hw) FILTER (WHERE n = 25) AS fnh FROM w)
SELECT round(b / u, 9) AS observed, round((b - fp * r + fn * d) / u, 9) AS corrected,
  round(least((b - fph * r + fnl * d) / u, (b - fpl * r + fnh * d) / u), 9) AS low, round(greatest((b - fph * r + fnl * d) / u, (b - fpl * r + fnh * d) / u), 9) AS high FROM c, e""")
def label_error_correction(spark, d):
    return r9(catalogue.correction(_counts(spark, d), 1, 40, 8, 25), "observed", "corrected", "low", "high")


USES = {1995: ("train", ""), 1996: ("train", ""), 1997: ("train", ""), 1998: ("val", ""), 1999: ("test", ""), 2000: ("excluded", "shock year")}


@query("cohort_inclusion", PR + """
SELECT cohort, round(avg(target), 9) AS churn, CASE WHEN cohort <= 1997 THEN 'train' WHEN cohort = 1998 THEN 'val' WHEN cohort = 1999 THEN 'test' ELSE 'excluded' END AS use,
  CASE WHEN cohort = 2000 THEN 'shock year' ELSE '' END AS reason, CASE WHEN cohort <= 1999 THEN 'yes' ELSE 'no' END AS included,
  CASE WHEN cohort <= 1999 THEN 'used: ' || use ELSE 'excluded: shock year' END AS detail FROM labelled GROUP BY 1""")
def cohort_inclusion(spark, d):
    churn = labelled(spark, d).groupBy("cohort").agg(F.round(F.avg("target"), 9).alias("churn"))
    return catalogue.cohort_table(churn, USES)


# -------------------------------------------------------------------- income
IND = "Net income per person"
INC = "WITH " + INCOME_SQL + """,
base AS (SELECT *, CAST(period AS INT) AS year, TRY_CAST(replace(replace(trim(total), '.', ''), ',', '.') AS DOUBLE) AS income FROM income_rows
  WHERE municipality LIKE '28079%' AND indicator = 'Net income per person'),
sec AS (SELECT *, right(split_part(section, ' ', 1), 5) AS code FROM base WHERE section IS NOT NULL),
dis AS (SELECT *, right(split_part(district, ' ', 1), 2) AS code FROM base WHERE section IS NULL)"""
MAP = INC + """,
map AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code, n_name || '-' || CAST(s_suppkey % 2 AS VARCHAR) AS area, n_name AS district, n_nationkey
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""
BYAREA = MAP + """,
g AS (SELECT area, year, avg(income) AS income FROM sec JOIN map ON map.code = sec.code WHERE income IS NOT NULL GROUP BY 1, 2),
by_area AS (SELECT * FROM g UNION ALL SELECT area, y, income FROM g, (SELECT unnest([2000, 2001]) AS y) WHERE year = 1999)"""


def _income(spark, d):
    sections, districts = income.split_income(income_rows(spark, d), IND)
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = s.select(
        F.col("s_suppkey").cast("string").alias("section"),
        F.concat(" n_name ".strip(), F.lit("-"), (F.col("s_suppkey") % 2).cast("string")).alias("barrio"),
        F.col("n_name").alias("district"),
    )
    return sections, districts, income.section_map(p, "section", "barrio", "district")


@query("income_series_scan", INC + """ SELECT 'section' AS kind, code, year, income FROM sec UNION ALL SELECT 'district', code, year, income FROM dis""")
def income_series_scan(spark, d):
    sections, districts, _ = _income(spark, d)
    cols = ("code", "year", "income")
    return sections.select(F.lit("section").alias("kind"), *cols).unionByName(districts.select(F.lit("district").alias("kind"), *cols))


@query("spanish_numbers", "WITH " + INCOME_SQL + " SELECT s_suppkey, TRY_CAST(replace(replace(trim(total), '.', ''), ',', '.') AS DOUBLE) AS v FROM income_rows")
def spanish_numbers(spark, d):
    return income_rows(spark, d).select("s_suppkey", grouped_number("total").alias("v"))


@query("section_to_area_map", MAP + " SELECT code, area, district FROM map")
def section_to_area_map(spark, d):
    return _income(spark, d)[2]


@query("income_by_area_year", BYAREA + " SELECT area, year, round(income, 6) AS income FROM by_area")
def income_by_area_year(spark, d):
    sections, _, mapping = _income(spark, d)
    out = income.income_by_area_year(sections, mapping, 1999, 2001)
    return out.withColumn("income", F.round("income", 6))


@query("income_last_known", BYAREA + """,
sc AS (SELECT area, y AS year FROM (SELECT DISTINCT area FROM g), (SELECT CAST(unnest(range(1995, 2002)) AS INT) AS y)),
j AS (SELECT sc.area, sc.year, g.income FROM sc LEFT JOIN g ON g.area = sc.area AND g.year = sc.year)
SELECT area, year, round(last_value(income IGNORE NULLS) OVER (PARTITION BY area ORDER BY year ROWS UNBOUNDED PRECEDING), 6) AS income FROM j""")
def income_last_known(spark, d):
    sections, _, mapping = _income(spark, d)
    g = income.income_by_area_year(sections, mapping, 1999, 1999)
    return history.last_known(g, "area", "year", "income", 1995, 2001).withColumn("income", F.round("income", 6))


ATTACH = BYAREA + """,
names AS (SELECT code, district FROM (SELECT left(code, 2) AS code, district, row_number() OVER (PARTITION BY left(code, 2) ORDER BY count(*) DESC, district) AS rn
  FROM map GROUP BY 1, 2) WHERE rn = 1),
gd AS (SELECT n.district, year, avg(income) AS income FROM dis JOIN names n ON n.code = dis.code WHERE income IS NOT NULL GROUP BY 1, 2),
by_district AS (SELECT * FROM gd UNION ALL SELECT district, y, income FROM gd, (SELECT unnest([2000, 2001]) AS y) WHERE year = 1999),
snap2 AS (SELECT id, anio, district, district || '-' || CAST(id % 2 AS VARCHAR) AS area, id % 4 = 0 AS hit FROM snaps),
att AS (SELECT s.*, a.income AS ia, b.income AS ib FROM snap2 s LEFT JOIN by_area a ON a.area = s.area AND a.year = s.anio
  LEFT JOIN by_district b ON b.district = s.district AND b.year = s.anio),
fin AS (SELECT id, anio, hit, coalesce(ia, ib, (SELECT quantile_cont(coalesce(ia, ib), 0.5) FROM att)) AS income,
  CASE WHEN ia IS NOT NULL THEN 'area' WHEN ib IS NOT NULL THEN 'district' ELSE 'median' END AS income_source FROM att)"""
ATTACH = ATTACH.replace("WITH ", "WITH " + SNAPSHOTS_SQL + ",\n", 1)


def incomes(spark, d):
    """Income by area and year, and by district and year."""
    sections, districts, mapping = _income(spark, d)
    return income.income_by_area_year(sections, mapping, 1999, 2001), income.income_by_district_year(districts, mapping, 1999, 2001)


def _attached(spark, d):
    by_area, by_district = incomes(spark, d)
    s = snapshots(spark, d).select(
        "id", "anio", "district", F.concat("district", F.lit("-"), (F.col("id") % 2).cast("string")).alias("area"),
        (F.col("id") % 4 == 0).cast("int").alias("hit"),
    )
    return income.attach_income(s, by_area, by_district, "area", "district", "anio")


@query("income_attached", ATTACH + " SELECT id, anio, round(income, 6) AS income, income_source FROM fin")
def income_attached(spark, d):
    return _attached(spark, d).select("id", "anio", F.round("income", 6).alias("income"), "income_source")


@query("turnover_by_income_quintile", ATTACH + """,
q AS (SELECT quantile_cont(income, [0.2, 0.4, 0.6, 0.8]) AS q FROM fin)
SELECT CASE WHEN income <= q[1] THEN 1 WHEN income <= q[2] THEN 2 WHEN income <= q[3] THEN 3 WHEN income <= q[4] THEN 4 ELSE 5 END AS quintile,
  count(*) AS n, round(avg(CAST(hit AS INT)), 9) AS rate, round(avg(income), 4) AS mean_income FROM fin, q GROUP BY 1""")
def turnover_by_income_quintile(spark, d):
    q = evaluate.value_quintiles(_attached(spark, d), "income")
    return q.groupBy("quintile").agg(
        F.count("*").alias("n"), F.round(F.avg("hit"), 9).alias("rate"), F.round(F.avg("income"), 4).alias("mean_income")
    )


@query("income_coverage", ATTACH + """,
known AS (SELECT DISTINCT code FROM sec WHERE income IS NOT NULL)
SELECT s.anio, count(*) AS n_open, round(avg(CAST(k.code IS NOT NULL AS INT)), 9) AS by_section, round(avg(CAST(a.area IS NOT NULL AS INT)), 9) AS by_area
FROM snaps s LEFT JOIN known k ON k.code = lpad(CAST(s.id AS VARCHAR), 5, '0')
LEFT JOIN by_area a ON a.area = s.district || '-' || CAST(s.id % 2 AS VARCHAR) AND a.year = s.anio WHERE s.open GROUP BY 1""")
def income_coverage(spark, d):
    sections, _, mapping = _income(spark, d)
    by_area = income.income_by_area_year(sections, mapping, 1999, 2001)
    s = snapshots(spark, d).select(
        "anio", "open", F.col("id").cast("string").alias("section"), F.concat("district", F.lit("-"), (F.col("id") % 2).cast("string")).alias("area")
    )
    return r9(income.income_coverage(s, "section", "area", "anio", sections, by_area), "by_section", "by_area")


# ------------------------------------------------------ catalogue and requests
PROFILES = [
    {"profile": "new", "age": 0.0, "turnovers": 0}, {"profile": "settled", "age": 3.0, "turnovers": 0},
    {"profile": "turning", "age": 0.0, "turnovers": 2},
]


@query("scenario_grid", """SELECT p_type AS activity, n_name AS district, profile, age, turnovers
FROM (SELECT DISTINCT p_type FROM part), nation, (SELECT 'new' AS profile, 0.0::DOUBLE AS age, 0 AS turnovers UNION ALL SELECT 'settled', 3.0, 0 UNION ALL SELECT 'turning', 0.0, 2)""")
def scenario_grid(spark, d):
    codes = table(spark, d, "part").select(F.col("p_type").alias("activity")).distinct()
    return catalogue.scenario_grid(codes, NATIONS, PROFILES)


@query("scenario_point", """SELECT p_type AS activity, n_name AS district, 'settled' AS profile FROM (SELECT DISTINCT p_type FROM part), nation
WHERE p_type = 'PROMO' AND n_name = 'NATION_4'""")
def scenario_point(spark, d):
    grid = scenario_grid(spark, d)
    return ranking.point_filter(grid, activity="PROMO", district="NATION_4", profile="settled").select("activity", "district", "profile")


@query("resolved_columns", "WITH " + RAW_SQL + """
SELECT 'x_text' AS name, count(*) AS n, CAST(count_if(trim(x_text) <> '') AS BIGINT) AS n_filled FROM raw
UNION ALL SELECT 'situation', count(*), CAST(count_if(trim(situation) <> '') AS BIGINT) FROM raw
UNION ALL SELECT 'group_x_text', count(*), CAST(count_if(trim(group_x_text) <> '') AS BIGINT) FROM raw""")
def resolved_columns(spark, d):
    """Columns under any of their known names, by name or by part of it, and how often they are filled."""
    rows = raw_rows(spark, d)
    names = [
        clean.resolve_column(rows.columns, ["coordenada_x_local", "X_TEXT", "x"]), clean.resolve_column(rows.columns, ["desc_situacion", "situa"], substring=True),
        clean.resolve_column(rows.columns, ["coordenada_x_agrup", "group_x"], substring=True)]
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("c")
    return rows.select(told).select("c.*").groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.trim("v") != "").alias("n_filled"))


@query("required_columns", "WITH " + RAW_SQL + """
SELECT name, name NOT IN ('income', 'barrio') AS present, CASE WHEN name NOT IN ('income', 'barrio') THEN (SELECT count(*) FROM raw) ELSE 0 END AS n
FROM (SELECT unnest(['id', 'anio', 'label', 'income', 'barrio']) AS name)""")
def required_columns(spark, d):
    """Which of the columns that a later step needs are there."""
    rows = raw_rows(spark, d)
    needed = ["id", "anio", "label", "income", "barrio"]
    missing = clean.missing_columns(rows.columns, needed)
    total = rows.agg(F.count("*").alias("n"))
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c not in missing).alias("present")) for c in needed])).alias("c")
    return total.select(listed, "n").select("c.name", "c.present", F.when(F.col("c.present"), F.col("n")).otherwise(0).alias("n"))


REQ_SQL = """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN 'NOPE' ELSE upper(split_part(p_name, ' ', 2)) END AS activity, c_mktsegment AS division,
  CASE WHEN o_orderkey % 29 = 0 THEN 'Atlantis' ELSE ' ' || lower(n_name) END AS district, 'puerta calle' AS access,
  CAST(o_orderkey % 150 AS DOUBLE) AS age, CAST(o_orderkey % 60 AS INT) AS t
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))
SELECT id, coalesce(n_name, district) AS district, 'Puerta Calle' AS access,
  array_to_string(list_filter([CASE WHEN activity = 'NOPE' THEN 'unknown activity' END, CASE WHEN n_name IS NULL THEN 'unknown district' END,
    CASE WHEN age > 120 THEN 'age out of range' END, CASE WHEN t > 50 THEN 'turnovers out of range' END], lambda e: e IS NOT NULL), ',') AS errors,
  round(least(t / greatest(age, 1.0), 1.0), 9) AS turnover_rate
FROM r LEFT JOIN nation ON n_name = upper(trim(district))"""


@query("request_validation", REQ_SQL)
def request_validation(spark, d):
    out = _requests(spark, d)
    return out.select(
        "id", "district", "access", F.array_join("errors", ",").alias("errors"), F.round("turnover_rate", 9).alias("turnover_rate")
    )


def _requests(spark, d):
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    activity = F.upper(F.split_part("p_name", F.lit(" "), F.lit(2)))
    o = table(spark, d, "orders").withColumn("pk", F.col("o_orderkey") % part.agg(F.count("*")).scalar())
    j = (
        o.join(table(spark, d, "customer").hint("merge"), F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(part.hint("merge"), F.col("p_partkey") == F.col("pk"))
    )
    r = j.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 31 == 0, "NOPE").otherwise(activity).alias("activity"),
        F.col("c_mktsegment").alias("division"),
        F.when(F.col("o_orderkey") % 29 == 0, "Atlantis").otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("district"),
        F.lit("puerta calle").alias("access"),
        (F.col("o_orderkey") % 150).cast("double").alias("age"),
        (F.col("o_orderkey") % 60).cast("int").alias("previous_turnovers"),
    )
    access = panel(spark, d).select("access").distinct()
    return catalogue.validate_requests(
        r, part.select(activity.alias("activity")).distinct(), table(spark, d, "customer").select("c_mktsegment").distinct(),
        nation.select("n_name"), access,
    )
