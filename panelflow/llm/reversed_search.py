"""Ranked lexical search in reverse: the items are indexed, the documents are streamed.

The few stated items get an inverted index (term -> items with counts), which
is broadcast; each task turns a block of its documents into counts of indexed
terms, sends them through the index and keeps a bounded heap of the best
documents of each item.  The heaps of all tasks are merged in two steps.  A
first pass over the documents counts what the weights need: documents and terms
in all, and the documents of each indexed term.

Integer arithmetic throughout (``div`` rounds down), with n terms in a
document, N documents with a term, L terms in all, df documents of a term::

    w     = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m     = 100 - 25 + (25 n N) div L
    score = sum over the item's terms, repeats included, of
            w * ((1000000000 tf) div (1000 tf + 12 m))

Items beyond ``BLOCK_BYTES`` of text are searched block by block, each block a
pass of its own, so the broadcast index is bounded whatever the items; a single
item is never divided.

Terms are maximal runs of characters that are neither ASCII marks nor white
space nor controls; only A-Z are lower-cased.  Defined results: documents and
items that are null, empty or without terms rank nowhere.  Repeated rows, of
documents or items, each count and rank as a row; equal scores go by ascending
id, null ids last.  Empty tables give an empty result; further columns are
ignored.  Document ids are integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.store import Store

#: Text of the items of one pass; their index takes about ten times as much.
BLOCK_BYTES = 4 << 20
#: Scores held at once in a task (documents of a block x items).
CELLS = 1 << 18
#: Groups of tasks whose heaps are merged first.
MERGERS = 32
_EXACT = 1 << 53
_NULL_ID = 1 << 63

_fold = bytearray(range(256))
for _c in range(128):
    if not chr(_c).isalnum():
        _fold[_c] = 32
for _c in range(65, 91):
    _fold[_c] = _c + 32
_FOLD = bytes(_fold)


def terms(text: bytes) -> list[bytes]:
    """Terms of a text, in order."""
    return text.translate(_FOLD).split()


class Index:
    """Postings of a block of items."""

    def __init__(self, items: list[bytes]) -> None:
        self.items = len(items)
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for i, text in enumerate(items):
            for term, count in Counter(terms(text)).items():
                k = self.terms.setdefault(term, len(self.terms))
                if k == len(postings):
                    postings.append([])
                postings[k].append((i, count))
        self.sizes = np.array([len(p) for p in postings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.count = np.array([c for p in postings for _, c in p], np.int64)

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        """Sets what a posting's share of a term counts."""
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in frequency]
        self.weight = self.count * np.repeat(np.array(w, np.int64), self.sizes)
        most = np.bincount(self.item, weights=self.weight, minlength=self.items).max(initial=0) * 1_000_000
        self.exact = most < _EXACT  # sums of doubles are exact

    def scores(self, rows: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores (rows x items) of counts ``tf`` of ``term`` in ``doc``, with ``m`` per document."""
        share = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        sizes = self.sizes[term]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[term] - ends + sizes, sizes)
        cell = np.repeat(doc * self.items, sizes) + self.item[at]
        value = np.repeat(share, sizes) * self.weight[at]
        if self.exact:
            flat = np.bincount(cell, weights=value, minlength=rows * self.items).astype(np.int64)
        else:
            flat = np.zeros(rows * self.items, np.int64)
            np.add.at(flat, cell, value)
        return flat.reshape(rows, self.items)


def _statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and documents of each indexed term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.terms
        n, total, frequency = 0, 0, Counter()
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()):
                found = terms(text.as_py() or b"")
                n += bool(found)
                total += len(found)
                frequency.update(set(map(known.get, found)))
        frequency.pop(None, None)
        frequency[-1], frequency[-2] = n, total
        yield pa.RecordBatch.from_arrays([pa.array(list(frequency), pa.int64()), pa.array(list(frequency.values()), pa.int64())], names=["term", "c"])

    sums = {r["term"]: r["c"] for r in docs.mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(k, 0) for k in range(len(index.value.terms))], np.int64)


class _Heaps:
    """The ``k`` best (score, -id) of each item."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)  # lower scores cannot enter

    def add(self, scores: np.ndarray, ids: list[int]) -> None:
        rows, items = np.nonzero(scores >= self.floor)
        for score, row, item in zip(scores[rows, items].tolist(), rows.tolist(), items.tolist()):
            heap, entry = self.heaps[item], (score, -ids[row])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]


def _best(docs: DataFrame, shared, k: int) -> DataFrame:
    """(part, item, doc_id, score): the heaps of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, documents, total = shared.value
        heaps = _Heaps(index.items, k)
        limit = max(1, CELLS // index.items)
        known = index.terms
        for batch in batches:
            ids = [_NULL_ID if i is None else i for i in batch.column(0).to_pylist()]
            texts = batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, limit):
                doc, term, tf, m = [], [], [], []
                for row, text in enumerate(texts.slice(a, limit)):
                    found = terms(text.as_py() or b"")
                    counts = Counter(map(known.get, found))
                    counts.pop(None, None)
                    doc += [row] * len(counts)
                    term += counts.keys()
                    tf += counts.values()
                    m.append(75 + (25 * len(found) * documents) // total if found else 75)
                doc, term, tf, m = (np.array(x, np.int64) for x in (doc, term, tf, m))
                heaps.add(index.scores(len(m), doc, term, tf, m), ids[a : a + limit])
        out = [(item, entry) for item, heap in enumerate(heaps.heaps) for entry in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % MERGERS] * len(out), pa.int32()), pa.array([i for i, _ in out], pa.int64()),
             pa.array([None if e[1] == -_NULL_ID else -e[1] for _, e in out], pa.int64()), pa.array([e[0] for _, e in out], pa.int64())],
            names=["part", "item", "doc_id", "score"])

    return docs.mapInArrow(run, "part int, item long, doc_id long, score long")


def _merged(heaps: DataFrame, k: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, doc id, score): the ``k`` best documents of every item, with scores above 0."""
    spark = docs.sparkSession
    store = Store(spark, "search")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))))
    found = []
    for block in range(blocks):
        rows = placed.where(F.col("block") == block).drop("block").collect()  # about BLOCK_BYTES
        index = Index([r["text"].encode() for r in rows])
        if not index.terms:
            continue
        shared = spark.sparkContext.broadcast(index)
        documents, total, frequency = _statistics(docs, shared)
        shared.destroy()
        index.weigh(documents, frequency)
        shared = spark.sparkContext.broadcast((index, documents, total))
        heaps = _merged(_merged(_best(docs, shared, k), k, "item", "part").drop("rank"), k, "item")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found.append(store.keep(heaps.join(F.broadcast(names), "item"), "best"))
        shared.destroy()
    if not found:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, found).select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
