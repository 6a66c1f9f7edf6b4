"""Detection of periodic runs on grammar-compressed texts.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
equal) of at least ``max(least, times * q)`` words that neither neighbouring
word extends.  Per document:

1. *Compress.*  Re-Pair on the word ids gives a grammar; the sequence that is
   left over is halved into a balanced tree.
2. *Cross.*  Every run lies inside a smallest node of the derivation and crosses
   the boundary between its two children.  Each rule is searched once, at its
   first place in the text, for the stretches that cross its boundary.  Half of
   a run lies on one side of the boundary, so the four words next to it recur
   one period away on that side: only those distances are tried, after a
   comparison of hashes, and measured word by word.
3. *Translate and merge.*  The stretches of a rule are moved to all places that
   it derives.  Those that end at the edge of a rule are parts of a run that a
   larger node holds; per period, stretches contained in another one go.

A rule with fewer than ``least`` words holds no run, so it is neither searched
nor followed.  Work is about n log n for n words, whatever repeats.

Words are runs of bytes outside ``\\x20\\x09-\\x0D``.  Defined results: a null,
empty or word-less text has no runs and collapses to the empty text.  Every row
gives one row, null and repeated ids included; equal exponents prefer the
smaller start, then the smaller period.  An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.repair import Grammar, compress

LEAST = 24
TIMES = 3
#: Words next to a boundary that must recur; a run's longer side repeats at least ``LEAST / 6`` words one period away.
GRAM = 4
#: Bytes of text in one Arrow batch of results.
OUT_BYTES = 4 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240917)
_words = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64)

Run = tuple[int, int, int]  # start, end, period


class _Text:
    """Word ids with what tells quickly whether stretches of them are equal."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.ids = ids
        self.powers = np.cumprod(np.full(n + 1, _MULTIPLIER, np.uint64))
        mixed = _words[ids & 0xFFFF] * (ids.astype(np.uint64) | np.uint64(1))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.powers[:n], out=self.total[1:])
        grams = mixed[: n - 3] * np.uint64(_MULTIPLIER)
        for i in range(1, GRAM):
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[i : n - 3 + i]
        self.order = np.argsort(grams, kind="stable")
        same = grams[self.order]
        new = np.concatenate(([True], same[1:] != same[:-1]))
        edges = np.flatnonzero(np.concatenate((new, [True])))
        group = np.cumsum(new) - 1
        self.rank = np.empty(n - 3, np.int64)
        self.rank[self.order] = np.arange(n - 3)
        self.last = np.empty(n - 3, np.int64)
        self.last[self.order] = edges[group + 1]
        self.first = np.empty(n - 3, np.int64)
        self.first[self.order] = edges[group]
        repeats = self.last - self.first > 1
        self.repeats = repeats.tolist()
        self.any = bool(repeats.any())

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``a`` have the hash of those from ``b`` (a <= b)."""
        return (self.total[a + size] - self.total[a]) * self.powers[b - a] == (self.total[b + size] - self.total[b]) * self.powers[0]

    def forward(self, i: int, j: int, stop: int) -> int:
        """Equal words from ``i`` and ``j`` on, ``j`` below ``stop``."""
        done, step = 0, 32
        while j + done < stop:
            m = min(step, stop - j - done)
            differ = self.ids[i + done : i + done + m] != self.ids[j + done : j + done + m]
            at = int(differ.argmax())
            if differ[at]:
                return done + at
            done += m
            step *= 2
        return done

    def backward(self, i: int, j: int, stop: int) -> int:
        """Equal words before ``i`` and ``j``, down to ``stop``."""
        done, step = 0, 32
        while i - done > stop:
            m = min(step, i - done - stop)
            differ = self.ids[i - done - m : i - done] != self.ids[j - done - m : j - done]
            at = int(differ[::-1].argmax())
            if differ[m - 1 - at]:
                return done + at
            done += m
            step *= 2
        return done

    def crossing(self, b: int, low: int, high: int, least: int, times: int) -> list[Run]:
        """Stretches inside ``[low, high)`` around the boundary before word ``b``."""
        found: dict[tuple[int, int], int] = {}
        for right in (True, False):
            at = b if right else b - GRAM
            if at < low or at + GRAM > high or not self.repeats[at]:
                continue
            if right:
                others = self.order[self.rank[at] + 1 : self.last[at]]
                periods = others[: np.searchsorted(others, high)] - at
            else:
                others = self.order[self.first[at] : self.rank[at]]
                periods = at - others[np.searchsorted(others, low) :][::-1]
            # the longer side holds half of the run
            half = np.maximum(-(-least // 2), -(-times * periods // 2))
            fits = half <= (high - b if right else b - low)
            periods, size = periods[fits], (half - periods)[fits]
            if not len(periods):
                continue
            start = np.full(len(periods), b) if right else b - periods - size
            periods = periods[self.same(start, start + periods, size)]
            while len(periods):
                q = int(periods[0])
                i = b if right else b - q
                s = i - self.backward(i, i + q, low)
                e = i + q + self.forward(i, i + q, high)
                periods = periods[1:]
                if e - s >= max(least, times * q):
                    found[s, e] = min(q, found.get((s, e), q))
                    # longer distances inside this stretch are multiples of its period
                    periods = periods[(periods < 2 * q) | (periods > (e - b if right else b - s) - q)]
        return [(s, e, q) for (s, e), q in found.items()]


def _halves(starts: list[int], n: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(boundary, low, high) of the nodes of the balanced tree over the left-over sequence."""
    edges = [*starts, n]
    stack = [(0, len(starts))]
    while stack:
        a, z = stack.pop()
        if z - a < 2 or edges[z] - edges[a] < least:
            continue
        middle = (a + z) // 2
        yield edges[middle], edges[a], edges[z]
        stack += [(a, middle), (middle, z)]


def _derived(grammar: Grammar, least: int) -> Iterator[tuple[list[int], int, int]]:
    """(places, size of the left child, size) of every rule of at least ``least`` words."""
    base, rules = grammar.terminals, grammar.rules
    sizes = [1] * base
    for left, right in rules:
        sizes.append(sizes[left] + sizes[right])
    places: dict[int, list[int]] = {}
    for symbol, start in zip(grammar.sequence, grammar.starts):
        if sizes[symbol] >= least:
            places.setdefault(symbol, []).append(start)
    for k in range(len(rules) - 1, -1, -1):  # a rule's symbol stands only in later rules
        where = places.pop(base + k, None)
        if where is None:
            continue
        left, right = rules[k]
        cut = sizes[left]
        if cut >= least:
            places.setdefault(left, []).extend(where)
        if sizes[right] >= least:
            places.setdefault(right, []).extend(p + cut for p in where)
        yield where, cut, sizes[base + k]


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of a sequence of small integers, as (start, end, period), by start, then period."""
    if least < 6 * GRAM or times < 3:
        raise ValueError(f"runs are sought from {6 * GRAM} words and three periods on")
    n = len(ids)
    if n < least:
        return []
    grammar = compress(ids, int(ids.max()) + 1)
    text = _Text(ids)
    if not text.any:
        return []
    stretches: dict[int, list[tuple[int, int]]] = {}
    for b, low, high in _halves(grammar.starts, n, least):
        for s, e, q in text.crossing(b, low, high, least, times):
            stretches.setdefault(q, []).append((s, e))
    for where, cut, size in _derived(grammar, least):
        p = where[0]
        for s, e, q in text.crossing(p + cut, p, p + size, least, times):
            stretches.setdefault(q, []).extend((s - p + o, e - p + o) for o in where)
    whole: dict[tuple[int, int], int] = {}
    for q, spans in stretches.items():
        end = -1
        for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
            if e > end:
                whole[s, e] = min(q, whole.get((s, e), q))
                end = e
    return sorted(((s, e, q) for (s, e), q in whole.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    out, at = [], 0
    for s, e in sorted((s + q, e) for s, e, q in runs):
        if s > at:
            out += words[at:s]
        at = max(at, e)
    return b" ".join(out + words[at:])


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) per row; ``runs`` holds (start, length, period) by start, then period.

    ``rewrite(id, words)`` may change the words of a row before they are searched.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, left, first, held = [], [], [], 0, 0
            ids = batch.column(0).to_pylist() if rewrite else None
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if rewrite:
                    words = rewrite(ids[i], words)
                runs = find_runs(word_ids(words), least, times)
                sizes.append(len(words))
                found.append([(s, e - s, q) for s, e, q in runs])
                left.append(collapse(words, runs))
                held += len(left[-1])
                if held > OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(found, run_type),
                         pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])
                    sizes, found, left, first, held = [], [], [], i + 1, 0

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(search, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]  # noqa: E731 - the first of equals stays
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
