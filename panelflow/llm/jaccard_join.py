"""N-gram Jaccard join by grouped prefixes.

Two documents link when ``100 * intersection >= percent * union`` of their
word-shingle sets.  Steps:

1. *Order.*  A fixed-width count sketch over the shingles of all documents
   gives every shingle a frequency level, another over their words gives every
   word one.  Shingles are ordered by (level, sum of their words' levels,
   hash): a passage shared by many documents comes last, and of the others
   those of rare words come first, which hardly meet by chance.  The sketches
   have ``SLOTS`` and ``WORD_SLOTS`` cells whatever the input; they decide
   speed only, any order is right.
2. *Group.*  Documents with equal size and equal prefix form one group; equal
   sets inside a group form one class.  Copies never reach the index.
3. *Join.*  The prefixes of groups meet in token buckets.  Tokens of level 0
   occur in few documents (the sketch never counts too low), so a window over
   the token does; frequent tokens are aggregated first and joined back.
   Buckets with the same members become one.  A bucket gives links to a hub
   first, not all its pairs.
4. *Filter, expand and verify.*  The tokens shared by two prefixes bound the
   intersection (``_possible``); pairs that cannot reach the threshold fall.
   The others are verified on whole sets.  Buckets whose classes already form
   one component are finished; from the others, classes outside the largest
   component meet some hubs of it (those that share most, so the least changed
   copies), and what then still is in different components meets pair by pair
   where a shared token stands early enough in both (``_early``).  So every
   pair that passes the bounds and could change a component is verified.

Defined results: a row with null, empty or word-less text has no shingles and
links with nothing; so does a row with null id.  A text with fewer words than a
shingle is one shingle.  Rows that repeat an id are judged each by its text and
all come back.  An empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.components import components
from panelflow.llm.shingles import cells, counted_sets, levelled_sets, shingle_sets
from panelflow.llm.store import Store, batch_rows

SLOTS = 1 << 22
WORD_SLOTS = 1 << 20
SLICES = 64
HUBS = 16
ROWS = 1000
#: Tables of ids are broadcast up to this number of rows (some 40 MB), joined by a shuffle beyond it.
SMALL_IDS = 1_000_000


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrow lists of signed 64-bit integers."""
    offsets = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _small(ids: DataFrame) -> DataFrame:
    """``ids``, marked for broadcasting if their number is within the bound."""
    return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, words = np.zeros(SLOTS, np.uint32), np.zeros(WORD_SLOTS, np.uint32)
    seen = False
    for batch in batches:
        for tokens in counted_sets(_bytes(batch.column(0)), words):
            seen |= len(tokens) > 0
            np.add.at(counts, cells(tokens, SLOTS), 1)
    if seen:
        parts = np.minimum(counts, 65535).astype("<u2").reshape(SLICES, -1), np.minimum(words, 65535).astype("<u2").reshape(SLICES, -1)
        for i in range(SLICES):  # most counts are small: few bits each once compressed
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32())} | {
                name: pa.array([pa.compress(p[i].tobytes(), "zstd", asbytes=True)]) for name, p in zip(("counts", "words"), parts)})


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            parts = [
                np.frombuffer(pa.decompress(blob, 2 * size // SLICES, "zstd", asbytes=True), "<u2").astype(np.int64)
                for blob, size in zip(blobs, (SLOTS, WORD_SLOTS))
            ]
            sums[i] = [a + b for a, b in zip(sums[i], parts)] if i in sums else parts
    for i, (total, words) in sums.items():
        mean = total.mean()
        excess = total - (mean + 6 * np.sqrt(mean) + 16)
        level = np.where(excess > 0, 1 + np.floor(np.log2(np.maximum(excess, 1)) * 2), 0)
        common = np.floor(np.log2(1 + words) * 6)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "levels": pa.array([level.astype(np.uint8).tobytes()]),
                                          "words": pa.array([np.minimum(common, 255).astype(np.uint8).tobytes()])})


def frequency_levels(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Level 0 (rare) to about 60 of each of the ``SLOTS`` cells of shingles, and 0 to 255 of the ``WORD_SLOTS`` cells of words."""
    spark = texts.sparkSession
    with batch_rows(spark, ROWS):
        rows = (
            texts.mapInArrow(_count, "slice int, counts binary, words binary")
            .repartition("slice")
            .mapInArrow(_total, "slice int, levels binary, words binary")
            .collect()  # SLOTS + WORD_SLOTS bytes in all
        )
    levels, words = np.zeros((SLICES, SLOTS // SLICES), np.uint8), np.zeros((SLICES, WORD_SLOTS // SLICES), np.uint8)
    for r in rows:
        levels[r["slice"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
        words[r["slice"]] = np.frombuffer(bytes(r["words"]), np.uint8)
    return levels.reshape(-1), words.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, levels: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(doc_id, text_key, rid, n, set_key, prefix_key, rare, frequent): the prefix in two parts."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    id_type = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, word_levels = shared.value
        for batch in batches:
            sizes, keys, prefix_keys, rare, frequent = [], [], [], [], []
            for tokens, common in levelled_sets(_bytes(batch.column(1)), word_levels):
                n = len(tokens)
                own = level[cells(tokens, SLOTS)]
                order = np.argsort(own.astype(np.int64) << 32 | common, kind="stable")[: prefix_length(n, percent) if n else 0]
                prefix, often = tokens[order], int((own[order] > 0).sum())
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                prefix_keys.append(xxhash.xxh3_128_digest(prefix.tobytes()))
                rare.append(prefix[: len(prefix) - often])
                frequent.append(prefix[len(prefix) - often :])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefix_keys, pa.binary()),
                 _lists(rare), _lists(frequent)],
                names=["doc_id", "text_key", "n", "set_key", "prefix_key", "rare", "frequent"],
            )

    out = docs.mapInArrow(run, f"doc_id {id_type}, text_key long, n long, set_key binary, prefix_key binary, rare array<long>, frequent array<long>")
    return out.withColumn("rid", F.monotonically_increasing_id())


def _whole_sets(docs: DataFrame, wanted: DataFrame, store: Store) -> DataFrame:
    """(node, tokens) of the ``wanted`` classes (doc_id, set_key, node)."""
    found = docs.join(_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(_bytes(batch.column(0))))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(sets)], names=["set_key", "tokens"])

    sets = found.mapInArrow(run, "set_key binary, tokens array<long>")
    with batch_rows(docs.sparkSession, ROWS):
        out = store.keep(sets.join(_small(wanted.select("set_key", "node")), "set_key").select("node", "tokens"), "whole")
    if out.count() > wanted.count():  # rows that repeat an id and its text
        out = store.keep(out.dropDuplicates(["node"]), "whole")
    return out


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with a boolean ``linked``, judged on whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - F.col("common")
    return (
        pairs.join(left, "a").join(right, "b").withColumn("common", common)
        .select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"))
    )


def _fits(percent: int, x: str = "na", y: str = "nb"):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _possible(percent: int, shared="shared", x: str = "na", y: str = "nb"):
    """Sizes fit, and the tokens ``shared`` by both prefixes leave room for a link.

    Past the smaller of two prefix ends, the intersection holds at most what
    that document has left; all of it before is in both prefixes.
    """
    left = F.greatest(*[F.ceil(F.col(n) * percent / 100) for n in (x, y)]) - 1
    return _fits(percent, x, y) & ((100 + percent) * ((F.col(shared) if isinstance(shared, str) else shared) + left) >= percent * (F.col(x) + F.col(y)))


def _early(percent: int, p: str = "pa", x: str = "na", q: str = "pb", y: str = "nb"):
    """The shared token stands before the part of each set that a link can do without.

    A link needs an intersection of percent / (100 + percent) of both sizes; in
    either set, its first token has at least so many tokens from its place on.
    """
    need = percent * (F.col(x) + F.col(y))
    return ((100 + percent) * (F.col(x) - F.col(p)) >= need) & ((100 + percent) * (F.col(y) - F.col(q)) >= need)


def _reaches(percent: int, p: str, n: str):
    """``_early`` for the smallest partner that fits."""
    return 100 * (100 + percent) * (F.col(n) - F.col(p)) >= percent * (100 + percent) * F.col(n)


def _judged(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, store: Store) -> DataFrame:
    """Verified ``pairs`` (a, b), from the whole sets of their classes; kept."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = store.keep(classes.select("doc_id", "set_key", F.col("cid").alias("node")).join(_small(nodes), "node"), "wanted")
    whole = _whole_sets(docs, wanted, store)
    out = store.keep(_verify(pairs, whole, percent), "judged")
    store.drop(whole)
    return out


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open_buckets(entries: DataFrame, links: DataFrame, store: Store) -> DataFrame:
    """(token, cid, n, comp, main) of buckets whose classes are in more than one component."""
    comps = components(links, store)
    seen = entries.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    main = (
        seen.groupBy("token", "comp").count()
        .groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("count", "comp")).alias("m"))
        .where("comps > 1").select("token", F.col("m.comp").alias("main"), F.col("m.count").alias("main_size"))
    )
    return store.keep(seen.join(main, "token"), "open")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id)."""
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    levels = frequency_levels(docs.select("text"))
    with batch_rows(spark, ROWS):
        sets = store.keep(_sets(docs, levels, percent), "sets")

    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    keyed = usable.select("doc_id", "rid", "n", "set_key", "prefix_key")
    classes = keyed.groupBy("n", "prefix_key", "set_key").agg(
        F.min("rid").alias("cid"), F.min_by("doc_id", "rid").alias("doc_id"), F.min("doc_id").alias("first_id"))
    groups = classes.groupBy("n", "prefix_key").agg(F.min("cid").alias("gid"), F.count("*").alias("members"))
    classes = store.keep(classes.join(groups, ["n", "prefix_key"]).drop("prefix_key"), "classes")
    rows = store.keep(sets.select("doc_id", "text_key", "n", "set_key"), "rows")

    # token buckets of groups
    heads = _small(classes.where("cid = gid").select(F.col("gid").alias("rid")))
    first = sets.join(heads, "rid", "left_semi").select(F.col("rid").alias("gid"), "rare", "frequent")
    mark = F.bit_xor(F.xxhash64("gid"))
    own = Window.partitionBy("token")
    rare = first.select("gid", F.posexplode("rare").alias("pos", "token")).select(
        "gid", "pos", F.count("*").over(own).alias("size"), F.min("gid").over(own).alias("least"), mark.over(own).alias("mark")).where("size > 1")
    often = store.keep(first.where(F.size("frequent") > 0).select("gid", F.size("rare").alias("before"), F.posexplode("frequent").alias("pos", "token")), "frequent")
    sums = often.groupBy("token").agg(F.count("*").alias("size"), F.min("gid").alias("least"), mark.alias("mark")).where("size > 1")
    often = often.join(sums, "token").select("gid", (F.col("before") + F.col("pos")).alias("pos"), "size", "least", "mark")
    index = rare.union(often).groupBy(F.xxhash64("size", "least", "mark").alias("token"), "gid").agg(
        F.count("*").alias("weight"), F.min("pos").alias("pos"))
    index = store.keep(index, "index")
    store.drop(sets)

    # hub pairs of groups, with the other classes of each group; the hub of a bucket is the member that shares most tokens
    score = store.keep(index.groupBy("gid").agg(F.sum("weight").alias("score")), "score")
    hubs = index.join(score, "gid").groupBy("token").agg(F.max_by("gid", F.struct(F.col("score"), -F.col("gid"))).alias("hub"))
    size = classes.where("cid = gid").select(F.col("gid"), "n")
    pairs = (
        index.join(hubs, "token").where("gid <> hub").groupBy("gid", "hub").agg(F.sum("weight").alias("shared"))
        .join(size.withColumnRenamed("n", "na"), "gid")
        .join(size.select(F.col("gid").alias("hub"), F.col("n").alias("nb")), "hub")
        .where(_possible(percent)).select(*_pair("gid", "hub"))
        .union(classes.where("cid <> gid").select(*_pair("cid", "gid")))
    )
    judged = _judged(store.keep(pairs, "pairs"), docs, classes, percent, store)
    links = judged.where("linked").select("a", "b")

    # buckets of classes: those of tokens, and one for each group with several classes
    members = classes.select("gid", "cid", "n")
    entries = (
        index.select("token", "gid", "weight", "pos").join(members, "gid").select("token", "cid", "n", "weight", "pos")
        .union(classes.where("members > 1").select(
            F.xxhash64(F.lit("group"), "gid").alias("token"), "cid", "n", F.col("n").alias("weight"), F.lit(0).alias("pos")))
    )
    entries = store.keep(entries, "entries")
    central = store.keep(entries.groupBy("cid").agg(F.sum("weight").alias("score")), "central")
    store.drop(index)

    # classes outside the largest component of a large bucket against some hubs of it
    open_ = _open_buckets(entries, links, store)
    ranked = Window.partitionBy("token").orderBy(F.desc("score"), "cid")
    hubs = (
        open_.where(f"comp = main AND main_size > {HUBS}").join(central, "cid").select("token", "cid", "n", "score").withColumn("r", F.row_number().over(ranked))
        .where(f"r <= {HUBS}").select("token", F.col("cid").alias("hub"), F.col("n").alias("nb"))
    )
    more = (
        open_.where(f"comp <> main AND main_size > {HUBS}").select("token", "cid", F.col("n").alias("na"), "weight").join(hubs, "token")
        .groupBy(F.col("cid").alias("x"), F.col("hub").alias("y"), "na", "nb").agg(F.sum("weight").alias("shared"))
        .where(_possible(percent)).select(*_pair("x", "y")).join(judged, ["a", "b"], "left_anti")
    )
    more = store.keep(more, "pairs")
    if not more.isEmpty():
        second = _judged(more, docs, classes, percent, store)
        judged = judged.union(second)
        links = links.union(second.where("linked").select("a", "b"))
        open_ = _open_buckets(entries, links, store)

    # what is still in different components, pair by pair
    scored = open_.join(central, "cid")  # no pair shares more tokens than either class shares with all others
    few = scored.where("comp <> main").select(
        "token", F.col("cid").alias("x"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("cx"), F.col("score").alias("sx"))
    all_ = scored.select(
        "token", F.col("cid").alias("y"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cy"), F.col("score").alias("sy"),
        (F.col("comp") == F.col("main")).alias("large"))
    # the last place that counts for a partner of equal size or less is the same for all: filtered before the join
    met = (
        few.where(_reaches(percent, "pa", "na")).join(all_.where(_reaches(percent, "pb", "nb")), "token")
        .where((F.col("cx") != F.col("cy")) & (F.col("large") | (F.col("x") < F.col("y"))) & _early(percent)
               & _possible(percent, F.least("sx", "sy")))
        .select("x", "y", "na", "nb").distinct()
    )
    # verified as they are: counting their shared tokens would take a row for each token of each pair
    rest = store.keep(met.select(*_pair("x", "y")).join(judged.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    third = _judged(rest, docs, classes, percent, store)
    links = links.union(third.where("linked").select("a", "b"))

    comps = components(links, store)
    store.drop(entries)
    placed = classes.select("cid", "set_key", "first_id").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "cid"))
    least = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = store.keep(placed.join(least, "comp").select("set_key", "component_id", "comp"), "named")
    # rows without shingles or id have no class: they keep their own id
    known = F.col("doc_id").isNotNull()
    return rows.join(named, "set_key", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(known, F.col("comp")).alias("component"), "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the one with its smallest id.

    Among rows that share this id, the one with the smallest text hash stays,
    and of equal texts one row.  Rows without words or id all stay.
    """
    store = Store(docs.sparkSession, "keep-one")
    found = near_duplicates(docs, id_col, text_col, percent).where("component IS NOT NULL")
    texts = store.keep(found.groupBy(F.col(id_col).alias("i"), F.col("text_key").alias("t"), "component", "component_id").count(), "texts")
    stays = texts.where("i = component_id").groupBy("component").agg(F.min(F.struct("t", "count")).alias("s"))
    lost = store.keep(
        texts.join(stays, "component").where((F.col("i") != F.col("component_id")) | (F.col("t") != F.col("s.t"))).select("i", "t"), "lost")
    repeated = store.keep(stays.where("s.count > 1").select(F.col("s.t").alias("t")).distinct(), "repeated")
    key = F.xxhash64(docs[text_col].cast("string"))
    lost_small = _small(lost)
    out = docs.join(lost_small, (docs[id_col] == lost_small["i"]) & (key == lost_small["t"]), "left_anti")
    if repeated.isEmpty():
        return out
    # rows that repeat id and text: an aggregate, so copies combine before their shuffle
    repeated = _small(repeated)
    again = F.col(id_col).isNotNull()
    key = F.xxhash64(F.col(text_col).cast("string"))
    rest = out.join(repeated, key == repeated["t"], "left_anti")
    some = out.join(repeated, key == repeated["t"], "left_semi")
    return rest.unionByName(some.where(~again)).unionByName(some.where(again).dropDuplicates([id_col, text_col]))
