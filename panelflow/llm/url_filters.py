"""URL filters: host rules first, then trust and distrust carried over the link graph.

*Rules.*  A rule is ``host/path``; it fits its host and all subdomains if the
URL's path starts with the rule's.  The longest fitting rule decides.

*Propagation.*  Edges lead from a page's host to the hosts its absolute links
name, once per pair of hosts.  Trust is personalised PageRank that restarts at
the trusted hosts and follows links; distrust restarts at the blocked hosts and
follows links backwards, so hosts that link to blocked ones take part of it.
A host whose distrust exceeds its trust, and ``LEAST`` times an even share of
the mass, is blocked; every other host is allowed.  A host is a seed if rules
allow, or block, more than half of its pages: a rule on a path is no verdict on
its whole host.

Iterations are joins of a rank table with the stored edges; mass is summed
before its shuffle, and ranks stay in the shared folder between iterations.
They end once the ranks' absolute changes sum to less than ``TOLERANCE``, which
damping brings about in some 150 steps on any graph; ``STEPS`` without that is an
error.

Defined results: a null URL, or one without ``://``, has empty host and path,
no rule and verdict ``allow``.  Null html has no links.  Repeated rows are
judged each; further columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import Store

DAMPING = 0.85
#: Of the summed absolute change in a step; what is unsettled then is at most 6 times that.
TOLERANCE = 1e-10
STEPS = 200
#: Distrust of a host, in even shares of the whole mass, from which it is blocked.
LEAST = 0.05


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, *LOWER), path


def match(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts; ``pages`` has host and html."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    targets = pages.where("html IS NOT NULL AND host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(links)).alias("url"))
    dst, _ = url_parts(F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url")))
    return targets.select("src", dst.alias("dst")).where("dst <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, store: Store, steps: int = STEPS, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, mass): settled personalised PageRank from ``seeds`` (host) along ``edges`` (src, dst); masses sum to at most 1."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    edges = store.keep(edges.join(degree, "src"), "edges")
    seeds = store.keep(seeds.select("host").distinct(), "seeds")
    n = max(1, seeds.count())
    rank = store.keep(seeds.withColumn("mass", F.lit(1.0 / n)), "rank")
    start = seeds.withColumn("mass", F.lit((1 - damping) / n))
    for _ in range(steps):
        moved = edges.join(rank, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (damping * F.col("mass") / F.col("degree")).alias("mass"))
        both = moved.union(start).withColumn("old", F.lit(0.0)).union(rank.select("host", F.lit(0.0).alias("mass"), F.col("mass").alias("old")))
        after = store.keep(both.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), "rank")
        store.drop(rank)
        rank = after
        change = rank.agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0] or 0.0
        if change < tolerance:
            return rank.select("host", "mass")
    raise RuntimeError(f"the ranks of hosts did not settle in {steps} steps: the last changed them by {change:.3g} in all, more than {tolerance:.3g}")


def judge_urls(pages: DataFrame, rules: list[Rule], least: float = LEAST, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) per page."""
    store = Store(pages.sparkSession, "urls")
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    ruled = store.keep(rows.drop("html").withColumn("m", match(F.col("host"), F.col("path"), rules)), "ruled")
    kinds = store.keep(ruled.where("host <> ''").groupBy("host").agg(
        (2 * F.count_if(F.col("m.verdict") == "allow") > F.count("*")).alias("trusted"),
        (2 * F.count_if(F.col("m.verdict") == "block") > F.count("*")).alias("blocked")), "hosts")
    edges = store.keep(host_edges(rows), "links")
    trust = propagate(edges, kinds.where("trusted"), store)
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), kinds.where("blocked"), store)
    # hosts with distrust only: what has none is allowed in any case
    scored = distrust.withColumnRenamed("mass", "distrust").join(trust.withColumnRenamed("mass", "trust"), "host", "left").fillna(0.0, ["trust"])
    scored = store.keep(scored, "scored")
    share = 1.0 / max(1, scored.count())
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > least * share)
    return ruled.join(scored, "host", "left").select(
        F.col("page_id").alias(id_col), "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce(F.col("m.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
