"""Packing of documents into token windows by Karmarkar-Karp differencing.

A document is its token ids and an end id.  Full windows are cut off first; the
rest of a document is cut into near-equal pieces of at most ``PIECE`` ids.  Each
task takes its pieces in blocks that ``BLOCK`` windows hold with ``SLACK`` ids
to spare in each (the piece at the edge is cut), and divides a block by multiway
differencing: every piece
starts as a partition of one filled and else empty windows; the two partitions
with the largest imbalance are merged, fullest against emptiest, until one is
left.  If a window exceeds the capacity, the block is divided again into one
window more.  Windows of a block are near-equal, so padding is the slack of the
window count.  Blocks are bounded and made where the rows are: nothing is
shuffled, and a task that runs again gives the same windows.

Defined results: null text counts as empty, its document is the end id alone.
Repeated rows are packed each.  An empty table gives no pieces; further columns
are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from panelflow.llm.units import encoder

CAPACITY = 2048
#: Rows whose token ids a task holds at once.
ROWS = 1000
BLOCK = 64
PIECE = 512
SLACK = 20
END = 1


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` sets of near-equal sums."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(k)]
    tie = len(sizes)
    while len(heap) > 1:
        _, _, xs, xi = heapq.heappop(heap)
        _, _, ys, yi = heapq.heappop(heap)
        total = [a + b for a, b in zip(xs, reversed(ys))]
        sets = [a + b for a, b in zip(xi, reversed(yi))]
        order = sorted(range(k), key=total.__getitem__, reverse=True)
        total, sets = [total[o] for o in order], [sets[o] for o in order]
        heapq.heappush(heap, (total[-1] - total[0], tie, total, sets))
        tie += 1
    return heap[0][3]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sets of indices whose sums are within ``capacity``; no size may exceed it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return [w for w in out if w]
        k += 1


def _encoded(batch: pa.RecordBatch, library) -> Iterator[tuple[object, np.ndarray]]:
    """(id, token ids) of every row; the ids of ``ROWS`` rows are held at once."""
    for a in range(0, batch.num_rows, ROWS):
        part = batch.slice(a, ROWS)
        yield from zip(part.column(0).to_pylist(), library.ids(part.column(1).to_pylist()))


def pack(docs: DataFrame, tokenizer_file: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; ``with_ids`` adds the ids."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = rows.drop("text__").schema
    id_type = None
    for name in names[1:7]:
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        library = encoder(tokenizer_file)
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        waiting: list[tuple] = []
        waiting_tokens = 0
        block = BLOCK * max(1, capacity - SLACK)

        def place(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                out.append((doc, start, len(ids), crc, total, sequence, offset, *([ids.astype(np.int32)] * with_ids)))
                offset += len(ids)
            sequence += 1

        def divide() -> None:
            nonlocal waiting_tokens
            for w in windows([len(p[2]) for p in waiting], capacity):
                place([waiting[i] for i in w])
            waiting.clear()
            waiting_tokens = 0

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:7]],
                 *[pa.array(list(c), pa.list_(pa.int32())) for c in columns[7:]]], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, ids in _encoded(batch, library):
                ids = np.append(ids, np.uint32(END))
                whole = len(ids) - len(ids) % capacity
                for a in range(0, whole, capacity):
                    place([(doc, a, ids[a : a + capacity], len(ids))])
                k = -(-(len(ids) - whole) // PIECE)
                edges = [whole + i * (len(ids) - whole) // k for i in range(k + 1)] if k else []
                for a, b in zip(edges, edges[1:]):
                    while b > a:
                        part = min(b, a + block - waiting_tokens)
                        waiting.append((doc, a, ids[a:part], len(ids)))
                        waiting_tokens += part - a
                        a = part
                        if waiting_tokens == block:
                            divide()
                if len(out) >= 5000:
                    yield rows_out()
        divide()
        if out:
            yield rows_out()

    return rows.mapInArrow(run, schema)
