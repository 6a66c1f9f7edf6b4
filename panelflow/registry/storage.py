"""Sources and sinks, exercised by writing the tables out and reading them back."""

from pyspark.sql import functions as F

from panelflow.functions.numbers import decimal_comma
from panelflow.functions.similarity import ratcliff_ratio
from panelflow.operators import income
from panelflow.plans.inputs import (
    PAIRS_SQL, RAW_SQL, REQUESTS_SQL, SCORES_SQL, SNAPSHOTS_SQL, income_rows, panel, ratio_sql, raw_rows, requests, scores, snapshots,
)
from panelflow.registry.core import query
from panelflow.registry.labelling import labelled
from panelflow.registry.rollups import INC, IND
from panelflow.session import scratch_path
from panelflow.sources import files, sinks

YEARS = range(1995, 2002)
HEADER = ("id", "row_key", "sign", "situation", "x_text", "access")


def _fields(year):
    """Columns in the file of a year: odd years lack the access column."""
    return [c for c in HEADER if c != "access" or year % 2 == 0]


def _csv_files(spark, d):
    """Raw rows of every year as separate semicolon files of two encodings."""
    raw = raw_rows(spark, d).withColumn("sign", F.concat("label", F.lit(" Ñandú")))
    root = scratch_path(spark, "csv")
    paths = []
    for year in YEARS:
        encoding = "UTF-8" if year % 3 else "ISO-8859-1"
        path = f"{root}/register_{year}_12.csv"
        out = raw.where(F.col("anio") == year).select(*_fields(year))
        out.write.options(sep=";", header=True, encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        paths.append(path)
    return paths


@query("snapshot_csv_files", "WITH " + RAW_SQL + """
SELECT CAST(id AS VARCHAR) AS id, CAST(row_key AS VARCHAR) AS row_key, label || ' Ñandú' AS sign, CASE WHEN anio % 2 = 0 THEN trim(access) END AS access,
  anio, CAST(12 AS INT) AS mes FROM raw""")
def snapshot_csv_files(spark, d):
    out = files.read_snapshot_files(spark, _csv_files(spark, d), ["id", "row_key", "sign"], ["access"])
    return out.withColumn("access", F.trim("access"))


@query("csv_header_columns", " UNION ALL ".join(f"SELECT 'register_{y}_12.csv' AS file, unnest({_fields(y)}) AS column" for y in YEARS))
def csv_header_columns(spark, d):
    return files.header_table(spark, _csv_files(spark, d))


@query("partitioned_panel", "WITH " + SNAPSHOTS_SQL + " SELECT id, anio, label FROM snaps WHERE anio IN (1998, 2000)")
def partitioned_panel(spark, d):
    path = scratch_path(spark, "panel-by-year")
    sinks.write_panel(snapshots(spark, d), path)
    return files.read_panel(spark, path, [1998, 2000], ["id", "anio", "label"])


@query("dataset_columns", "WITH " + SNAPSHOTS_SQL + " SELECT id, label, anio AS cohort FROM snaps")
def dataset_columns(spark, d):
    path = scratch_path(spark, "dataset-by-cohort")
    sinks.write_dataset(snapshots(spark, d).withColumnRenamed("anio", "cohort"), path, ["id", "absent", "label", "cohort"])
    return spark.read.parquet(path).select("id", "label", "cohort")


@query("two_locale_csv", "WITH " + SCORES_SQL + " SELECT id, p, 'dot' AS locale FROM scores UNION ALL SELECT id, p, 'comma' FROM scores")
def two_locale_csv(spark, d):
    path = scratch_path(spark, "export")
    sinks.write_two_locales(scores(spark, d).select("id", "p"), path)
    dot = files.read_snapshot_csv(spark, path, sep=",", encoding="UTF-8").select(
        F.col("id").cast("long").alias("id"), F.col("p").cast("double").alias("p"), F.lit("dot").alias("locale")
    )
    comma = files.read_snapshot_csv(spark, path + "_es", sep=";", encoding="UTF-8").select(
        F.col("id").cast("long").alias("id"), decimal_comma("p").alias("p"), F.lit("comma").alias("locale")
    )
    return dot.unionByName(comma)


@query("sniffed_separator", "WITH " + SCORES_SQL + " SELECT id, p FROM scores")
def sniffed_separator(spark, d):
    path = scratch_path(spark, "unknown-separator")
    scores(spark, d).select("id", "p").write.options(header=True, sep=";").csv(path)
    out = files.read_snapshot_csv(spark, path, sep=files.sniff_separator(spark, path), encoding="UTF-8")
    return out.select(F.col("id").cast("long").alias("id"), F.col("p").cast("double").alias("p"))


@query("scored_table_scan", "WITH " + SNAPSHOTS_SQL + """
SELECT CAST(id AS VARCHAR) AS id, label, activity, district, barrio, x, y, round((id % 101) / 101.0::DOUBLE, 4) AS p, CAST(1 AS INT) AS decile FROM snaps WHERE anio = 2001 AND label <> ''""")
def scored_table_scan(spark, d):
    path = scratch_path(spark, "scored")
    s = snapshots(spark, d).where("anio = 2001 and label <> ''")
    s.select(
        "id", "label", "activity", "district", "barrio", "x", "y", F.round((F.col("id") % 101) / F.lit(101.0), 4).alias("p"), F.lit(1).alias("decile")
    ).write.option("header", True).csv(path)
    return files.read_scored(spark, path)


@query("spatial_input_export", "WITH " + SNAPSHOTS_SQL + " SELECT CAST(id AS VARCHAR) AS id, x, division FROM snaps WHERE anio = 2001")
def spatial_input_export(spark, d):
    path = scratch_path(spark, "points-csv")
    sinks.export_spatial_input(snapshots(spark, d).where("anio = 2001"), path)
    out = files.read_snapshot_csv(spark, path, sep=",", encoding="UTF-8")
    return out.select("id", F.col("x").cast("double").alias("x"), "division")


@query("single_file_export", "WITH " + SCORES_SQL + " SELECT h, CAST(count(*) AS VARCHAR) AS n FROM scores GROUP BY 1")
def single_file_export(spark, d):
    path = scratch_path(spark, "single")
    sinks.write_single_csv(scores(spark, d).groupBy("h").agg(F.count("*").alias("n")), path)
    return files.read_snapshot_csv(spark, path, sep=",", encoding="UTF-8")


@query("appended_log", "WITH " + REQUESTS_SQL + " SELECT request_id, activity, strftime(ts, '%Y-%m-%d') AS day FROM requests")
def appended_log(spark, d):
    path = scratch_path(spark, "log")
    r = requests(spark, d).select("request_id", "activity", "ts")
    sinks.append_log(r.where("request_id % 2 = 0"), path)
    sinks.append_log(r.where("request_id % 2 = 1"), path)
    return spark.read.parquet(path).select("request_id", "activity", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("json_summary", "WITH " + SCORES_SQL + " SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS hits FROM scores")
def json_summary(spark, d):
    path = scratch_path(spark, "summary")
    sinks.write_summary(scores(spark, d).agg(F.count("*").alias("n"), F.sum("y").alias("hits")), path)
    return files.read_json_document(spark, path).select("n", "hits")


@query("income_csv", INC + " SELECT 'section' AS kind, code, year, income FROM sec UNION ALL SELECT 'district', code, year, income FROM dis")
def income_csv(spark, d):
    path = scratch_path(spark, "income")
    income_rows(spark, d).drop("n_name", "s_suppkey").write.options(sep=";", header=True).csv(path)
    sections, districts = income.split_income(files.read_income_csv(spark, path), IND)
    cols = ("code", "year", "income")
    return sections.select(F.lit("section").alias("kind"), *cols).unionByName(districts.select(F.lit("district").alias("kind"), *cols))


@query("catalogue_xml", "SELECT DISTINCT 'actividades' AS kind, CAST(year(o_orderdate) AS INT) AS anio, CAST(3 AS INT) AS mes, 1.5::DOUBLE AS mb FROM orders")
def catalogue_xml(spark, d):
    path = scratch_path(spark, "xml")
    years = spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").alias("y")).distinct()
    rows = years.select("y", F.explode(F.array(F.lit("text/csv"), F.lit("text/html"))).alias("kind"))
    entries = rows.select(
        F.format_string(
            "<dcat:Distribution><dct:title>Actividades. Marzo %d</dct:title><dcat:accessURL>http://example.org/f</dcat:accessURL>"
            "<dcat:mediaType>%s</dcat:mediaType><dcat:byteSize>1500000</dcat:byteSize></dcat:Distribution>", "y", "kind",
        ).alias("e")
    )
    # a document of two entries per year
    entries.agg(F.concat(F.lit("<rdf:RDF>"), F.array_join(F.collect_list("e"), ""), F.lit("</rdf:RDF>"))).write.text(path)
    return files.read_catalogue_xml(spark, path).select("kind", "anio", "mes", "mb")


@query("label_similarity", "WITH RECURSIVE " + PAIRS_SQL + ratio_sql("SELECT norm AS a, norm1 AS b FROM labelled WHERE differs") + """
SELECT a AS norm, b AS norm1, round(ratio, 6) AS ratio FROM ratios""")
def label_similarity(spark, d):
    pairs = labelled(spark, d).where("differs").select("norm", "norm1").distinct()
    return pairs.select("norm", "norm1", F.round(ratcliff_ratio("norm", "norm1"), 6).alias("ratio"))


@query("sql_view", "WITH " + SNAPSHOTS_SQL + " SELECT district, count(*) AS n FROM snaps WHERE open GROUP BY 1")
def sql_view(spark, d):
    """Every operator result can be queried as a view."""
    panel(spark, d).createOrReplaceTempView("panel_view")
    return spark.sql("SELECT district, count(*) AS n FROM panel_view WHERE open GROUP BY district")
