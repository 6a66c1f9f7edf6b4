"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import Store


def components(edges: DataFrame, store: Store, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps, each a grouped minimum and
    a distinct, so a hub with many edges is pre-aggregated before its shuffle.
    Edges stay in the shared folder between rounds; only their count and a
    checksum reach the driver.  An empty edge table gives an empty result.
    """
    now = store.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        after = store.keep(small, "edges")
        new = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        store.drop(now)
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)
