"""Panel-shaped inputs derived from the generic star-schema tables.

Each function has a SQL twin in ``SQL`` (a list of CTEs) that the oracle
queries start from.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions.text import normalise, vocabulary_words
from panelflow.operators.rollup import official_vocabulary
from panelflow.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders that one task sorts to find the first ones of its customers.
ORDERS = 500_000


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (id, anio): yearly register of "premises".

    The first order of a customer in a year stands for the premises.  The least
    struct is found by a sort, so the orders are spread first: a task sorts
    about ``ORDERS`` of them, however large the files are.
    """
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    tasks = math.ceil(orders.count() / ORDERS)  # from the footers
    first = (
        orders.select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("anio"), "o_orderdate", "o_orderkey", "o_orderstatus")
        .repartition(max(tasks, spark.sparkContext.defaultParallelism), "id")
        .groupBy("id", "anio")
        .agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("f"))
        .select("id", "anio", F.col("f.o_orderkey").alias("ok"), F.col("f.o_orderstatus").alias("status"))
    )
    n_parts = part.agg(F.count("*")).scalar()
    shift = F.when(F.col("ok") % 5 == 0, F.col("anio")).otherwise(0)
    keyed = first.withColumn("partkey", (F.col("id") * 7 + shift) % n_parts)
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        keyed.join(customer.hint("merge"), keyed.id == customer.c_custkey)  # customers and parts grow: small files do not make small hash tables
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(part.hint("merge"), keyed.partkey == part.p_partkey)
        .select(
            "id",
            "anio",
            F.when(F.col("ok") % 37 == 0, "NO INFORMADO")
            .when(F.col("ok") % 41 == 0, "")
            .otherwise(F.upper("p_name"))
            .alias("label"),
            F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("activity"),
            F.col("status"),
            (F.col("status") != "F").alias("open"),
            F.when(F.col("ok") % 11 != 0, F.col("c_mktsegment")).alias("division"),
            F.col("p_type").alias("section"),
            F.col("n_name").alias("district"),
            F.concat("n_name", F.lit("-"), (F.col("id") % 5).cast("string")).alias("barrio"),
            (F.lit(440000.0) + (F.col("id") * 37) % 3000).alias("x"),
            (F.lit(4474000.0) + (F.col("id") * 91) % 3000).alias("y"),
            F.when(F.col("id") % 7 == 0, F.concat(F.lit("G"), (F.col("id") % 13).cast("string"))).alias("mall"),
            F.when(F.col("ok") % 3 == 0, "Agrupado").when(F.col("ok") % 29 == 0, "Interior")
            .otherwise("Puerta Calle").alias("access"),
            F.col("ok").alias("row_key"),
        )
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw register: several rows per (id, anio), text as published."""
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    n_parts = part.agg(F.count("*")).scalar()
    keyed = orders.withColumn("partkey", (F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % n_parts)
    return keyed.join(part, keyed.partkey == part.p_partkey).select(
        F.col("o_custkey").alias("id"),
        F.year("o_orderdate").alias("anio"),
        F.col("o_orderkey").alias("row_key"),
        F.when(F.col("o_orderkey") % 41 == 0, "").otherwise(F.upper("p_name")).alias("label"),
        F.concat(
            F.lit("  "),
            F.when(F.col("o_orderstatus") == "F", "Cerrado")
            .when(F.col("o_orderkey") % 23 == 0, "Uso vivienda")
            .when(F.col("o_orderkey") % 19 == 0, "Baja")
            .otherwise("Abierto"),
            F.lit("  "),
        ).alias("situation"),
        F.when(F.col("o_orderkey") % 17 == 0, "n/d")
        .when(F.col("o_orderkey") % 13 == 0, "0")
        .otherwise(F.concat((F.lit(440000) + (F.col("o_custkey") * 37) % 3000).cast("string"), F.lit(",5 ")))
        .alias("x_text"),
        F.when(F.col("o_orderkey") % 31 == 0, "9,25")
        .otherwise(F.concat((F.lit(4474000) + (F.col("o_custkey") * 91) % 3000).cast("string"), F.lit(",25")))
        .alias("y_text"),
        F.when(F.col("o_orderkey") % 2 == 0, "441000,0").alias("group_x_text"),
        F.when(F.col("o_orderkey") % 29 == 0, " Interior ")
        .when(F.col("o_orderkey") % 3 == 0, "Agrupado")
        .when(F.col("o_orderkey") % 43 == 0, None)
        .otherwise("Puerta Calle")
        .alias("access"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("toxic").alias("y"),
        (1 - F.col("quality")).alias("y2"),
        F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 2).alias("p"),
        F.round(F.col("n_chars") / (F.col("n_chars") + 500.0), 2).alias("p2"),
        F.col("lang").alias("g"),
        F.col("source").alias("h"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_columns(table(spark, sf_dir, "events"))


def request_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("activity"),
        F.col("user_id").alias("client"),
        (F.col("value") / 500).alias("probability"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("user_id") % 3 == 0, "v1").otherwise("v2").alias("version"),
    )


def income_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published income series: section rows and district rows, as text."""
    s = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    section_code = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    amount = F.concat(
        F.floor(F.abs("s_acctbal") / 1000).cast("string"),
        F.lit("."),
        F.lpad((F.floor(F.abs("s_acctbal")) % 1000).cast("string"), 3, "0"),
        F.lit(",5"),
    )
    district_code = F.concat(F.lit("28079"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return s.select(
        F.when(F.col("s_suppkey") % 10 == 9, F.lit("08019 Other")).otherwise("28079 City").alias("municipality"),
        F.concat(district_code, F.lit(" district")).alias("district"),
        F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("28079"), section_code, F.lit(" section"))).alias("section"),
        F.when(F.col("s_suppkey") % 4 == 3, "Other indicator").otherwise("Net income per person").alias("indicator"),
        (1995 + F.col("s_suppkey") % 5).cast("string").alias("period"),
        F.when(F.col("s_suppkey") % 13 == 0, ".").otherwise(amount).alias("total"),
        "n_name",
        "s_suppkey",
    )


SNAPSHOTS_SQL = """snaps AS (
  SELECT o.id AS id, o.anio AS anio,
    CASE WHEN ok % 37 = 0 THEN 'NO INFORMADO' WHEN ok % 41 = 0 THEN '' ELSE upper(p_name) END AS label,
    upper(split_part(p_name, ' ', 2)) AS activity, status, status <> 'F' AS open,
    CASE WHEN ok % 11 <> 0 THEN c_mktsegment END AS division, p_type AS section,
    n_name AS district, n_name || '-' || CAST(o.id % 5 AS VARCHAR) AS barrio,
    440000.0::DOUBLE + (o.id * 37) % 3000 AS x, 4474000.0::DOUBLE + (o.id * 91) % 3000 AS y,
    CASE WHEN o.id % 7 = 0 THEN 'G' || CAST(o.id % 13 AS VARCHAR) END AS mall,
    CASE WHEN ok % 3 = 0 THEN 'Agrupado' WHEN ok % 29 = 0 THEN 'Interior' ELSE 'Puerta Calle' END AS access,
    ok AS row_key
  FROM (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INT) AS anio, o_orderkey AS ok, o_orderstatus AS status,
          row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn
        FROM orders) o
  JOIN customer ON c_custkey = o.id
  JOIN nation ON n_nationkey = c_nationkey
  JOIN part ON p_partkey = (o.id * 7 + CASE WHEN ok % 5 = 0 THEN anio ELSE 0 END) % (SELECT count(*) FROM part)
  WHERE rn = 1)"""

RAW_SQL = """raw AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) AS INT) AS anio, o_orderkey AS row_key,
    CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE upper(p_name) END AS label,
    '  ' || CASE WHEN o_orderstatus = 'F' THEN 'Cerrado' WHEN o_orderkey % 23 = 0 THEN 'Uso vivienda'
      WHEN o_orderkey % 19 = 0 THEN 'Baja' ELSE 'Abierto' END || '  ' AS situation,
    CASE WHEN o_orderkey % 17 = 0 THEN 'n/d' WHEN o_orderkey % 13 = 0 THEN '0'
      ELSE CAST(440000 + (o_custkey * 37) % 3000 AS VARCHAR) || ',5 ' END AS x_text,
    CASE WHEN o_orderkey % 31 = 0 THEN '9,25'
      ELSE CAST(4474000 + (o_custkey * 91) % 3000 AS VARCHAR) || ',25' END AS y_text,
    CASE WHEN o_orderkey % 2 = 0 THEN '441000,0' END AS group_x_text,
    CASE WHEN o_orderkey % 29 = 0 THEN ' Interior ' WHEN o_orderkey % 3 = 0 THEN 'Agrupado'
      WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'Puerta Calle' END AS access
  FROM orders JOIN part ON p_partkey = (o_custkey * 7 + o_orderkey % 3) % (SELECT count(*) FROM part))"""

SCORES_SQL = """scores AS (
  SELECT d.doc_id AS id, toxic AS y, 1 - quality AS y2,
    round(n_chars / (n_chars + 2000.0::DOUBLE), 2) AS p, round(n_chars / (n_chars + 500.0::DOUBLE), 2) AS p2,
    lang AS g, source AS h
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

REQUESTS_SQL = """requests AS (
  SELECT event_id AS request_id, ts, event_type AS activity, user_id AS client, value / 500 AS probability,
    CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CASE WHEN user_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS version
  FROM events)"""

INCOME_SQL = """income_rows AS (
  SELECT CASE WHEN s_suppkey % 10 = 9 THEN '08019 Other' ELSE '28079 City' END AS municipality,
    '28079' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ' district' AS district,
    CASE WHEN s_suppkey % 7 <> 0 THEN '28079' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || ' section' END AS section,
    CASE WHEN s_suppkey % 4 = 3 THEN 'Other indicator' ELSE 'Net income per person' END AS indicator,
    CAST(1995 + s_suppkey % 5 AS VARCHAR) AS period,
    CASE WHEN s_suppkey % 13 = 0 THEN '.' ELSE
      CAST(CAST(floor(abs(s_acctbal) / 1000) AS BIGINT) AS VARCHAR) || '.' ||
      lpad(CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || ',5' END AS total,
    n_name, s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


# Panel: normalised label, distinctive words and placeholder mark.  The labels
# of the tables are plain upper-case words, so the label is its own normal form.
PANEL_SQL = (
    SNAPSHOTS_SQL
    + """,
vocab AS (SELECT list(DISTINCT activity) AS words FROM snaps WHERE length(activity) > 3),
panel AS (
  SELECT s.*, label AS norm, label = '' OR label = 'NO INFORMADO' AS ph,
    list_sort(list_filter(list_distinct(string_split(label, ' ')),
      lambda w: NOT list_contains(words, w) AND length(w) > 1)) AS core
  FROM snaps s, vocab)"""
)


def same_sql(a: str, b: str) -> str:
    """Cheap identity tests between rows aliased ``a`` (before) and ``b``."""
    return f"""({a}.norm = {b}.norm OR len({a}.core) = 0 OR len({b}.core) = 0 OR {b}.ph
      OR list_has_all({b}.core, {a}.core) OR list_has_all({a}.core, {b}.core)
      OR array_to_string({a}.core, '') = array_to_string({b}.core, '')
      OR replace({a}.norm, ' ', '') = replace({b}.norm, ' ', ''))"""


PAIRS_SQL = (
    PANEL_SQL
    + f""",
pairs AS (
  SELECT a.*, a.anio AS cohort, b.id IS NOT NULL AS present, coalesce(b.open, false) AS open1,
    coalesce(b.norm, '') AS norm1, coalesce({same_sql("a", "b")}, false) AS same_raw
  FROM panel a LEFT JOIN panel b ON b.id = a.id AND b.anio = a.anio + 1
  WHERE a.anio + 1 IN (SELECT anio FROM panel)),
labelled AS (
  SELECT *, NOT present AS gone, present AND NOT open1 AS closed, differs AND NOT same AS rotated,
    CAST(NOT present OR (present AND NOT open1) OR (differs AND NOT same) AS INT) AS target
  FROM (SELECT *, differs AND same_raw AS same
        FROM (SELECT *, present AND open1 AND norm1 <> '' AND norm1 <> norm AS differs FROM pairs
              WHERE open AND NOT ph AND len(core) > 0)))"""
)

HISTORY_SQL = (
    PAIRS_SQL
    + f""",
obs AS (
  SELECT b.id, b.anio, coalesce(NOT a.ph AND len(a.core) > 0 AND NOT b.ph AND len(b.core) > 0
      AND a.norm <> b.norm AND NOT {same_sql("a", "b")}, false) AS changed
  FROM panel b LEFT JOIN (
    SELECT id, anio, lag(anio) OVER (PARTITION BY id ORDER BY anio) AS prev FROM panel) l
    ON l.id = b.id AND l.anio = b.anio
  LEFT JOIN panel a ON a.id = b.id AND a.anio = l.prev),
hist AS (
  SELECT id, anio, min(anio) OVER w AS first_year,
    coalesce(max(CASE WHEN changed THEN anio END) OVER w, min(anio) OVER w) AS business_year,
    CAST(sum(CAST(changed AS INT)) OVER w AS BIGINT) AS turnovers
  FROM obs WINDOW w AS (PARTITION BY id ORDER BY anio ROWS UNBOUNDED PRECEDING))"""
)


def ratio_sql(pairs: str) -> str:
    """CTEs ``rp`` (a, b: the distinct ``pairs``) and ``ratios`` (a, b, ratio): the Ratcliff-Obershelp ratio by recursion.

    A step takes the longest common block of two strings (the first of equals
    in ``a``, then in ``b``) and goes on left and right of it.
    """

    def best(x: str, y: str) -> str:
        part = f"substr({x}, i, k)"
        return (
            f"list_reverse_sort(flatten([[{{'k': k, 'i': -i, 'j': -strpos({y}, {part})}} for k in range(1, length({x}) - i + 2) if contains({y}, {part})]"
            f" for i in range(1, length({x}) + 1)]))[1]"
        )

    return f""",
rp AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> ''),
seg AS (
  SELECT a, b, a AS x, b AS y, {best("a", "b")} AS m FROM rp
  UNION ALL
  SELECT a, b, s.x, s.y, {best("s.x", "s.y")} FROM (
    SELECT a, b, unnest([{{'x': substr(x, 1, -m.i - 1), 'y': substr(y, 1, -m.j - 1)}}, {{'x': substr(x, m.k - m.i), 'y': substr(y, m.k - m.j)}}]) AS s
    FROM seg WHERE m IS NOT NULL) WHERE s.x <> '' AND s.y <> ''),
ratios AS (SELECT a, b, 2.0::DOUBLE * coalesce(sum(m.k), 0) / (length(a) + length(b)) AS ratio FROM seg GROUP BY 1, 2)"""


def likely_sql(undecided: str) -> str:
    """CTEs up to ``likely`` (a, b): label pairs of ``undecided`` (a, b) that the fuzzy part of the identity rule takes for one business."""
    flat = "regexp_replace({0}, '[^A-Z0-9]', '', 'g')"
    return f""",
cores AS (SELECT DISTINCT norm, core FROM panel),
und AS (SELECT DISTINCT u.a, u.b, x.core AS ca, y.core AS cb, array_to_string(x.core, '') AS ja, array_to_string(y.core, '') AS jb,
    {flat.format("u.a")} AS fa, {flat.format("u.b")} AS fb
  FROM ({undecided}) u JOIN cores x ON x.norm = u.a JOIN cores y ON y.norm = u.b),
tok AS (SELECT a, b, t, unnest(cb) AS u FROM (SELECT a, b, cb, unnest(ca) AS t FROM und))""" + ratio_sql(
        "SELECT ja AS a, jb AS b FROM und UNION ALL SELECT fa, fb FROM und UNION ALL SELECT t, u FROM tok") + """,
near AS (SELECT a, b, count(*) AS n FROM (
    SELECT DISTINCT tok.a, tok.b, t FROM tok JOIN ratios r ON r.a = t AND r.b = u WHERE ratio >= 0.82) GROUP BY 1, 2),
likely AS (SELECT DISTINCT und.a, und.b FROM und LEFT JOIN ratios r ON r.a = ja AND r.b = jb LEFT JOIN ratios f ON f.a = fa AND f.b = fb
    LEFT JOIN near n ON n.a = und.a AND n.b = und.b
  WHERE coalesce(r.ratio >= 0.9, false) OR coalesce(f.ratio >= 0.9, false) OR coalesce(n.n, 0) / least(len(ca), len(cb)) >= 0.6)"""


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Intermediate table of the chain, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = materialise(build(), name)
    return _STORED[key]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean panel: snapshots with their normalised label.

    The first stage of the chain; later stages read the stored table.
    """
    return stored(spark, sf_dir, "panel", lambda: panel_rows(spark, sf_dir))


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).withColumn("norm", normalise("label"))


def vocabulary(spark: SparkSession, sf_dir: str):
    """Official vocabulary of the activities: words of the nomenclature."""
    return vocabulary_words(official_vocabulary(panel(spark, sf_dir), ["activity"]))
