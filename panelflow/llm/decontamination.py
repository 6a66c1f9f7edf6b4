"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: ones are hashed, zeros ignored,
so a substituted word at a zero leaves the hash as it was.  Windows of the
documents, without their texts, meet the seeds of the benchmark items by hash;
only for documents with a hit the words are fetched, in blocks that hold what
is compared around any hit that begins in them, and around each hit the words
of document and item are compared on their diagonal.  The pair is a leak if at
least ``PERCENT`` of the compared words are equal.  All steps are DataFrame
expressions.

A join of generated code holds all rows that one row of its streamed side makes.
So hits are streamed and meet one block each; a row has the size of a block,
whatever the length of its document and the number of its hits.

Words are lower-cased runs of letters and digits.  An item shorter than a mask
but of ``LEAST_WORDS`` words or more must occur whole; a shorter item matches
nothing.

Defined results: null and empty texts, of documents or items, have no leaks.
Repeated rows of a document id are one document in the report; the filter
judges each row.  Rows with null id come with a null id; an item id that has
several texts is all of them.  Empty tables give no leaks; further columns are
ignored by the report and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import Store

MASKS = ("11011000011", "11000110011")
SPAN = 11
LEAST_WORDS = 5
#: Words compared on either side of a hit.
AROUND = 4
PERCENT = 75
#: Words of a document in a block, besides those around its ends.
BLOCK = 128
#: More than the words compared at one place.
WIDE = 64
#: Tables of fixed-width rows are broadcast up to this number of rows (some 60 bytes each), joined by a shuffle beyond it.
SMALL_ROWS = 500_000
#: Words of items are broadcast up to this number of bytes.
SMALL_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(rows: DataFrame, words_col: str, masks: list[str]) -> DataFrame:
    """``rows`` without ``words_col``: one row per window and mask, with place ``p`` (from 1), mask number ``m`` and hash ``h``.

    The words under the ones of all masks are zipped into one array of structs
    that is unrolled, so hashing is plain generated code on columns.
    """
    keep = [c for c in rows.columns if c != words_col]
    ones = [[i for i, c in enumerate(mask) if c == "1"] for mask in masks]
    places = sorted({i for o in ones for i in o})
    later = [F.slice(words_col, i + 1, F.greatest(F.size(words_col) - i, F.lit(0))).alias(f"w{i}") for i in places]
    out = rows.select(*keep, F.posexplode(F.arrays_zip(*later)).alias("p", "z"))
    hashes = [F.when(F.col(f"z.w{o[-1]}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"z.w{i}") for i in o])) for k, o in enumerate(ones)]
    return out.select(*keep, (F.col("p") + 1).alias("p"), F.posexplode(F.array(*hashes)).alias("m", "h")).where("h IS NOT NULL")


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, marked for broadcasting if their number is within the bound, for a join by sort beyond it.

    Without the latter mark Spark goes by the size of files, which is 50 times smaller than the rows where columns repeat.
    """
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows.hint("merge")


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with words ``dw``: one row per block, with its number ``block``, its words ``bw``, the place ``low`` of the first and the document's ``dn``."""
    rows = rows.withColumn("dn", F.size("dw"))
    low = lambda b: F.greatest(F.lit(1), b * BLOCK + 1 - AROUND)
    high = lambda b: F.least(F.col("dn"), (b + 1) * BLOCK + SPAN - 1 + AROUND)
    cut = lambda b: F.struct(b.alias("block"), low(b).alias("low"), F.slice("dw", low(b), high(b) - low(b) + 1).alias("bw"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.col("dn") - 1) / BLOCK).cast("int")), cut)
    return rows.where("dn > 0").select(*[c for c in rows.columns if c != "dw"], F.explode(parts).alias("part")).select("*", "part.*").drop("part")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, n_places, matched, compared) per leaking document and item."""
    store = Store(docs.sparkSession, "leaks")
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text).cast("string")).alias("iw")).where(F.size("iw") >= LEAST_WORDS)
    items = store.keep(items.select("item_id", "iw", F.size("iw").alias("n"), F.xxhash64("item_id", "iw").alias("item_key")).dropDuplicates(["item_key"]), "items")
    short = sorted(r["n"] for r in items.select("n").where(f"n < {SPAN}").distinct().collect())  # at most SPAN - LEAST_WORDS
    masks = [*MASKS, *("1" * k for k in short)]
    length = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("m") + 1)
    places = seeds(items.select("item_key", "n", "iw"), "iw", masks).withColumn("len", length)
    places = store.keep(places.where(f"len >= least(n, {SPAN})").select("h", "item_key", F.col("p").alias("ip"), "len"), "seeds")

    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    windows = seeds(texts.select("doc_id", "text_key", words(F.col("text")).alias("dw")), "dw", masks)
    hits = windows.join(_small(places), "h").select("doc_id", "text_key", F.col("p").alias("dp"), "item_key", "ip", "len")
    hits = store.keep(hits, "hits")
    store.drop(places)

    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_key"] == y["text_key"])
    wanted = _small(hits.select("doc_id", "text_key").distinct())
    fetched = texts.join(wanted, same(texts, wanted), "left_semi").dropDuplicates(["doc_id", "text_key"])
    blocks = store.keep(_blocks(fetched.select("doc_id", "text_key", words(F.col("text")).alias("dw"))), "blocks").hint("merge")
    shape = items.select("item_key", "item_id", "iw", "n")
    held = items.agg(F.sum(F.octet_length(F.array_join("iw", " ")))).first()[0] or 0
    at = hits.withColumn("block", F.floor((F.col("dp") - 1) / BLOCK).cast("int"))
    met = at.join(blocks, same(at, blocks) & (at["block"] == blocks["block"])).drop(blocks["doc_id"]).drop(blocks["text_key"]).drop("block")
    met = met.join(F.broadcast(shape) if held <= SMALL_BYTES else shape.hint("merge"), "item_key")
    first = F.greatest(F.lit(1), F.col("ip") - AROUND, F.col("ip") - F.col("dp") + 1)
    last = F.least(F.col("n"), F.col("ip") + F.col("len") - 1 + AROUND, F.col("dn") + F.col("ip") - F.col("dp"))
    size = last - first + 1
    own = first + F.col("dp") - F.col("ip") - F.col("low") + 1
    equal = F.size(F.filter(F.zip_with(F.slice("iw", first, size), F.slice("bw", own, size), lambda a, b: a == b), lambda e: e))
    verified = met.select("doc_id", "text_key", "item_id", (F.col("dp") - F.col("ip")).alias("shift"), equal.alias("matched"), size.alias("compared"))
    # both counts in one number: its greatest is that of matched, then compared, and needs no sort
    score = F.when(100 * F.col("matched") >= PERCENT * F.col("compared"), F.col("matched") * WIDE + F.col("compared"))
    return (
        verified.groupBy("doc_id", "text_key", "item_id", "shift").agg(F.max(score).alias("m")).where("m IS NOT NULL")
        .groupBy("doc_id", "text_key", "item_id").agg(F.count("*").alias("n_places"), F.max("m").alias("m"))
        .select("doc_id", "text_key", "item_id", "n_places", F.floor(F.col("m") / WIDE).cast("int").alias("matched"), (F.col("m") % WIDE).alias("compared"))
    )


def filter_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns."""
    store = Store(docs.sparkSession, "decontaminated")
    bad = _small(store.keep(leaks(docs, benchmark, id_col, text_col).select("doc_id", "text_key").distinct(), "bad"))
    same = docs[id_col].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs[text_col]) == bad["text_key"])
    return docs.join(bad, same, "left_anti")
