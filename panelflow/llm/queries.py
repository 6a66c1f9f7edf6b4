"""Named queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm.chat_format import chat_windows, read_back
from panelflow.llm.decontamination import leaks
from panelflow.llm import html_extraction, periodic_runs, reversed_search, rule_ensemble
from panelflow.llm.jaccard_join import near_duplicates
from panelflow.llm.language_id import held_out, identify, train
from panelflow.llm.license_scan import scan
from panelflow.llm.packing import pack
from panelflow.llm.quality_rules import judge
from panelflow.llm.token_counts import count_tokens
from panelflow.llm.url_filters import judge_urls, rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


WORDS_SQL = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), x -> x <> '')"
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_ngram_jaccard_join", f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {WORDS_SQL.format(LOWER_SQL.format("coalesce(text, '')"))} AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_reduce(ws, lambda a, b: a || ' ' || b)]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: list_reduce(ws[i:i+4], lambda a, b: a || ' ' || b)) END) AS sh FROM w
), e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS t FROM s),
common AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
  WHERE 100 * c >= 75 * (len(a.sh) + len(b.sh) - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = s.doc_id
""".replace("x -> x <> ''", "lambda x: x <> ''"))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    out = judge(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words",
                      "base_failed", "kept", F.round("distance", 6).alias("distance"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, train(docs), ["doc_id", "held_out"])


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with the items."""
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.sum("n_places").alias("n_places"), F.max("matched").alias("matched"), F.max("compared").alias("compared"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(_table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS c FROM t
), s AS (
  SELECT *, pos = 1 AND role = 'system' AND c > 1 AS sys,
    12 + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '|', '\p')) + length(replace(replace(text, '\', '\\'), '<', '\l')) AS chars FROM p
), z AS (SELECT *, CASE WHEN sys THEN 0 ELSE CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 6 END AS size FROM s),
a AS MATERIALIZED (SELECT *, e - size AS f FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS e FROM z)),
w AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS f FROM a
  UNION ALL SELECT conv_id, f FROM (SELECT w.conv_id, w.f AS before, min(a.f) AS f FROM w JOIN a ON a.conv_id = w.conv_id AND a.e - w.f > 1280 AND a.f > w.f GROUP BY 1, 2)
),
h AS (SELECT w.conv_id, sum(a.chars) AS chars FROM w JOIN a ON a.conv_id = w.conv_id AND NOT sys AND a.e <= w.f AND a.f >= w.f - 512 GROUP BY 1),
y AS (SELECT conv_id, count(*) AS n FROM w GROUP BY 1)
SELECT a.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(a.chars) FILTER (WHERE NOT sys), 0) + coalesce(any_value(h.chars), 0) + any_value(y.n) * coalesce(max(a.chars) FILTER (WHERE sys), 0) AS BIGINT)
    AS formatted_chars
FROM a JOIN y ON y.conv_id = a.conv_id LEFT JOIN h ON h.conv_id = a.conv_id GROUP BY a.conv_id
"""


@query("op2_chat_format", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    stored = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = read_back(chat_windows(stored.unionByName(probe)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


RULES = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]


@query("op7_url_filters")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return judge_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.train(pages), ["page_id", "url"])


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan(_table(spark, sf_dir, "documents"))


@query("op11_rule_ensemble")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = rule_ensemble.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), allowed=~held)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


SEARCH_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), d AS MATERIALIZED (SELECT doc_id, ts, len(ts) AS n FROM t WHERE len(ts) > 0),
c AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY 1, 2
), f AS MATERIALIZED (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term
), s AS (
  SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM f JOIN w USING (term) JOIN q USING (term), c GROUP BY 1, 2
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""


@query("op12_reversed_search", SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return reversed_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In every tenth document by checksum, the words from some place on become repeats of a few of them."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, and the words without their repeats."""
    found = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=periodic_tail)
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
