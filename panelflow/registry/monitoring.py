"""Operational metrics of the request log: streams and their batch twins."""

from pyspark.sql import functions as F

from panelflow.plans.inputs import REQUESTS_SQL, request_columns, requests, table
from panelflow.registry.core import query
from panelflow.registry.evaluation import r9
from panelflow.streaming import monitor

RQ = "WITH " + REQUESTS_SQL
EDGES = monitor.HISTOGRAM_EDGES
BIN = "CASE " + " ".join(f"WHEN probability < {e} THEN {k}" for k, e in enumerate(EDGES[1:], 1)) + " END"


def stream(spark, d):
    events = table(spark, d, "events")
    return request_columns(monitor.read_log_stream(spark, d, events.schema, "events.parquet"))


@query("operation_summary", RQ + """
SELECT count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  round(avg(probability), 4) AS mean, round(min(probability), 4) AS min, round(quantile_cont(probability, 0.25), 4) AS p25,
  round(quantile_cont(probability, 0.5), 4) AS median, round(quantile_cont(probability, 0.75), 4) AS p75, round(max(probability), 4) AS max FROM requests""")
def operation_summary(spark, d):
    return monitor.operation_summary(requests(spark, d))


@query("probability_histogram", RQ + f""", b AS (SELECT {BIN} AS bin FROM requests),
f AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS bin, unnest({list(monitor.HISTOGRAM_NAMES)}) AS range)
SELECT CAST(f.bin AS INT) AS bin, range, count(b.bin) AS n FROM f LEFT JOIN b ON b.bin = f.bin GROUP BY 1, 2""")
def probability_histogram(spark, d):
    return monitor.histogram(requests(spark, d))


@query("most_consulted", RQ + " SELECT activity AS value, count(*) AS n FROM requests GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def most_consulted(spark, d):
    return monitor.most_consulted(requests(spark, d), "activity")


@query("version_mix", RQ + " SELECT version, count(*) AS n FROM requests GROUP BY 1")
def version_mix(spark, d):
    return monitor.version_mix(requests(spark, d))


H = ", ".join(f"count(*) FILTER (WHERE bin = {k}) AS h{k}" for k in range(1, 8))
WINDOW_SQL = RQ + f""", b AS (SELECT *, {BIN} AS bin, time_bucket(INTERVAL '1 day', ts) AS s FROM requests)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL '1 day', '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) AS n, round(avg(probability), 9) AS mean, min(probability) AS min, max(probability) AS max, {H} FROM b {{where}} GROUP BY s"""


@query("daily_metrics", WINDOW_SQL.format(where=""))
def daily_metrics(spark, d):
    return r9(monitor.window_metrics(requests(spark, d), "1 day"), "mean")


@query("daily_metrics_stream", WINDOW_SQL.format(where="WHERE s + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM requests)"))
def daily_metrics_stream(spark, d):
    out = monitor.window_metrics(stream(spark, d), "1 day", delay="1 hour")
    return r9(monitor.run_to_table(out, "daily"), "mean")


@query("deduplicated_stream", "SELECT event_id AS request_id, event_type AS activity FROM events")
def deduplicated_stream(spark, d):
    s = stream(spark, d)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return monitor.run_to_table(monitor.deduplicated(twice, "request_id"), "dedup").select("request_id", "activity")


SLIDE = RQ + """, e AS (SELECT activity, time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day' * back AS s FROM requests, (SELECT unnest([0, 1]) AS back)),
c AS (SELECT s, activity, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, activity) AS rn FROM c)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL '2 days', '%Y-%m-%d %H:%M:%S') AS window_end, activity, n
FROM t WHERE rn = 1 """


@query("top_activity_sliding", SLIDE)
def top_activity_sliding(spark, d):
    counts = monitor.window_metrics(requests(spark, d), "2 days", "1 day", by=("activity",))
    return monitor.top_per_window(counts.select("window_start", "window_end", "activity", "n"), "activity")


@query("top_activity_sliding_stream", SLIDE + " AND s + INTERVAL '2 days' <= (SELECT max(ts) - INTERVAL '1 hour' FROM requests)")
def top_activity_sliding_stream(spark, d):
    counts = monitor.window_metrics(stream(spark, d), "2 days", "1 day", by=("activity",), delay="1 hour")
    counts = counts.select("window_start", "window_end", "activity", "n")

    def rank(batch, _):
        return monitor.top_per_window(batch, "activity")

    schema = "window_start string, window_end string, activity string, n long"
    return monitor.run_each_batch(counts, "top", rank, schema)


PSI_W = RQ + """, ref AS (SELECT activity AS bin, count(*) AS n FROM requests WHERE k < 50 GROUP BY 1),
w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS s, activity AS bin, count(*) AS o FROM requests WHERE k >= 50 GROUP BY 1, 2),
tot AS (SELECT s, sum(o) AS n FROM w GROUP BY 1),
f AS (SELECT s, t.n, b.bin, pe FROM tot t, (SELECT bin, n / (SELECT sum(n) FROM ref) AS pe FROM ref UNION ALL SELECT '· other ·', 0) b),
j AS (SELECT f.s, f.n, greatest(pe, 1e-4) AS e, greatest(coalesce(o, 0) / f.n, 1e-4) AS ob FROM f LEFT JOIN w ON w.s = f.s AND w.bin = f.bin)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(max(n) AS BIGINT) AS n, round(sum((ob - e) * ln(ob / e)), 9) AS psi,
  CASE WHEN max(n) < 30 THEN 'no conclusion' WHEN sum((ob - e) * ln(ob / e)) < 0.1 THEN 'stable'
    WHEN sum((ob - e) * ln(ob / e)) < 0.25 THEN 'moderate drift' ELSE 'high drift' END AS verdict FROM j GROUP BY s"""


@query("daily_drift", PSI_W)
def daily_drift(spark, d):
    r = requests(spark, d)
    return r9(monitor.window_drift(r.where("k >= 50"), r.where("k < 50"), "activity", "1 day"), "psi")


@query("drift_stream", PSI_W)
def drift_stream(spark, d):
    """Counts per day and bin as a stream, judged like ``daily_drift``."""
    shares = monitor.reference_shares(requests(spark, d).where("k < 50"), "activity")
    counts = monitor.run_complete(monitor.window_bins(stream(spark, d).where("k >= 50"), shares, "activity", "1 day"), "drift")
    return r9(monitor.drift_of_windows(counts, shares), "psi")


@query("drift_on_closing_stream", PSI_W.replace("FROM j GROUP BY s", "FROM j WHERE s + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM requests WHERE k >= 50) GROUP BY s"))
def drift_on_closing_stream(spark, d):
    """A verdict per day, given when the day is over."""
    shares = monitor.reference_shares(requests(spark, d).where("k < 50"), "activity")
    closed = monitor.closing_drift(stream(spark, d).where("k >= 50"), shares, "activity", "1 day", "1 hour")
    return r9(monitor.run_to_table(closed, "closing"), "psi")
