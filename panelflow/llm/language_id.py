"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, runs of other characters than letters become one space,
and every character is scored in the context of the three before it.  A gram is
four 16-bit codes; letters beyond U+FFFF take one of the 2,048 codes that no
character has, so they share grams only among themselves.  Spark
counts the four-character grams of all training rows per language (partly
summed in each task, then added up), and all of them make the models.  The
language with the lowest cross-entropy per character wins.

Up to ``HELD_GRAMS`` grams in all, each model is a set of sorted arrays of gram
hashes with discounted probabilities and back-off weights, held by every task.
Beyond, Spark derives the same figures as stored tables per order, gives each
distinct gram of the scored texts its bits by joins with them, and sums them per
text: the results are equal but for the rounding of sums, and the tables grow
with the corpus.

``CALIBRATION_ROWS`` training rows of each language (about, a fourth of its rows
at most; chosen by a hash of their id and kept out of the counts) set the
temperature of the score and, per language, the median of its cross-entropy and
the excess over it that ``FALSE_REJECTS`` of these rows pass.  The excess shrinks
with the square root of ``1 + SETTLED / characters``, as short texts vary more.
A document is rejected if its score is under ``LEAST_SCORE`` or its excess above
that limit.  A language with fewer than ``LEAST_ROWS`` such rows takes the
highest median and limit of the others, or of all rows if there are no others.

Defined results: null text, and text without a letter, is ``und`` with score 0
and rejected.  Equal cross-entropies take the language first by name.  Without
training rows everything is ``und``.  Rows with null id or language train
nothing.  Repeated rows are scored alike; further columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import Store, batch_rows
from panelflow.llm.units import by_bytes

ORDER = 4
#: Models of more grams stay in tables; decides where the work is done, not the result.
HELD_GRAMS = 1_200_000
#: Of each language.
CALIBRATION_ROWS = 1000
LEAST_ROWS = 20
LEAST_SCORE = 0.5
#: Share of a language's calibration rows that its limit rejects.
FALSE_REJECTS = 0.002
#: Limit where the rows hardly differ, in bits.
LEAST_ROOM = 0.1
#: Texts of fewer characters get a wider limit.
SETTLED = 200
ROWS = 1000
#: Characters counted or scored at once.
CHUNK = 500_000
NONE = "und"
_DISCOUNT = 0.75
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_PAD = np.full(ORDER - 1, 32, np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Packed four-character grams of a text, one per character; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    high = codes >= 1 << 16
    letter = _LETTER[np.where(high, 0, codes)]
    if high.any():
        letter[high] = [chr(c).isalpha() for c in codes[high]]
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for its run
    if high.any():
        codes = np.where(high, 0xD800 + codes * np.uint32(40503) % 2048, codes)
    c = np.concatenate((_PAD, np.where(letter, codes, 32)[keep].astype(np.uint64)))
    g = c[: len(c) - ORDER + 1]
    for i in range(1, ORDER):
        g = (g << np.uint64(16)) | c[i : len(c) - ORDER + 1 + i]
    return g


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts per language of one task."""
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle() -> None:
        for lang, parts in waiting.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in totals:
                both = np.concatenate((totals[lang][0], g))
                counts = np.concatenate((totals[lang][1], n))
                g, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, counts).astype(np.int64)
            totals[lang] = (g, n)
        waiting.clear()

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (g, n) in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g)), "gram": pa.array(g.view(np.int64)), "n": pa.array(n.astype(np.int64))})
        totals.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            g = grams(text)
            if len(g):
                waiting.setdefault(lang, []).append(g)
                size += len(g)
            if size > CHUNK:
                settle()
                size = 0
        if sum(len(g) for g, _ in totals.values()) > 4_000_000:  # bounded memory: pass on and begin again
            yield from rows()
    settle()
    yield from rows()


@dataclass
class Model:
    """Sorted arrays of one language: per order, grams with probability parts and contexts with back-off weights."""

    grams: list[np.ndarray]
    parts: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float

    def probability(self, g: np.ndarray) -> np.ndarray:
        p = np.full(len(g), self.floor)
        for k in range(ORDER):
            own = g & np.uint64((1 << 16 * (k + 1)) - 1)
            p = _find(self.contexts[k], self.weights[k], own >> np.uint64(16), 1.0) * p + _find(self.grams[k], self.parts[k], own, 0.0)
        return p


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def kneser_ney(g: np.ndarray, n: np.ndarray) -> Model:
    """Model from distinct packed grams and their counts."""
    model = Model([], [], [], [], 0.0)
    counts = {ORDER: (g, n.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters to the left
        low, c = np.unique(counts[k + 1][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
        counts[k] = (low, c.astype(np.float64))
    model.floor = 1.0 / (len(counts[1][0]) + 1)
    for k in range(1, ORDER + 1):
        keys, c = counts[k]
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        total = np.bincount(at, c)
        model.grams.append(keys)
        model.parts.append(np.maximum(c - _DISCOUNT, 0) / total[at])
        model.contexts.append(context)
        model.weights.append(np.bincount(at, np.minimum(c, _DISCOUNT)) / total)
    return model


@dataclass
class Identifier:
    langs: list[str]
    models: list[Model]
    scale: float = 1.0
    middle: np.ndarray | None = None
    limit: np.ndarray | None = None

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored, and bits per character under every language, of each text."""
        sizes = np.zeros(len(texts), np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in by_bytes([t or "" for t in texts], CHUNK):
            each = [grams(t) for t in texts[a:b]]
            own = np.array([len(g) for g in each], np.int64)
            sizes[a:b] = own
            if own.sum() and self.langs:
                kinds, at = np.unique(np.concatenate(each), return_inverse=True)
                starts, some = np.cumsum(own) - own, own > 0
                for i, m in enumerate(self.models):
                    bits = -np.log2(m.probability(kinds))[at]
                    out[a:b][some, i] = np.add.reduceat(bits, starts[some]) / own[some]
        return sizes, out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        return self.decide(*self.entropies(texts))

    def decide(self, sizes: np.ndarray, bits: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection from the characters scored and the bits per character."""
        if not self.langs:
            return [NONE] * len(sizes), np.zeros(len(sizes)), np.ones(len(sizes), bool)
        best = bits.argmin(axis=1) if len(sizes) else np.zeros(0, np.int64)
        odds = np.exp(-self.scale * np.sqrt(np.maximum(sizes, 1))[:, None] * (bits - bits.min(axis=1, keepdims=True)))
        some = sizes > 0
        score = np.where(some, 1.0 / odds.sum(axis=1), 0.0)
        reject = ~some | (score < LEAST_SCORE)
        if self.limit is not None:
            reject |= _excess(sizes, bits[np.arange(len(sizes)), best], self.middle[best]) > self.limit[best]
        return [self.langs[b] if s else NONE for b, s in zip(best, some)], score, reject

    def calibrate(self, langs: list[str], sizes: np.ndarray, bits: np.ndarray) -> None:
        """Temperature, and middle and largest excess of the entropy of each language, from labelled rows."""
        index = {x: i for i, x in enumerate(self.langs)}
        rows = [i for i, x in enumerate(langs) if sizes[i] > 0 and x in index]
        if not rows:
            return
        true = np.array([index[langs[i]] for i in rows])
        sizes, bits = sizes[rows], bits[rows]
        gap = np.sqrt(sizes)[:, None] * (bits - bits.min(axis=1, keepdims=True))

        def loss(scale: float) -> float:
            odds = np.exp(-scale * gap)
            return -np.log(np.maximum(odds[np.arange(len(true)), true] / odds.sum(axis=1), 1e-6)).mean()

        self.scale = min((0.25 * 2.0**i for i in range(8)), key=loss)
        own = bits[np.arange(len(true)), true]
        mine = [np.flatnonzero(true == i) for i in range(len(self.langs))]
        known = [m if len(m) >= LEAST_ROWS else None for m in mine]
        some = [m for m in known if m is not None] or [np.arange(len(true))]
        found = []
        for m in some:
            middle = np.median(own[m])
            found.append((middle, max(LEAST_ROOM, np.quantile(_excess(sizes[m], own[m], middle), 1 - FALSE_REJECTS, method="higher"))))
        most = tuple(np.max(found, axis=0))
        left = iter(found)
        self.middle, self.limit = np.array([most if m is None else next(left) for m in known]).T


def _excess(sizes: np.ndarray, bits: np.ndarray, middle: np.ndarray | float) -> np.ndarray:
    """Bits above the middle, in the measure of long texts."""
    return (bits - middle) / np.sqrt(1 + SETTLED / np.maximum(sizes, 1))


def _low(gram: Column, k: int) -> Column:
    """The last ``k`` characters of packed grams."""
    return gram if k == ORDER else gram.bitwiseAND(F.lit((1 << 16 * k) - 1))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of each text with their counts."""
    for batch in batches:
        numbers, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in by_bytes([t or "" for t in texts], CHUNK):
            each = [np.unique(grams(t), return_counts=True) for t in texts[a:b]]
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.repeat(np.array(numbers[a:b], np.int64), [len(g) for g, _ in each])),
                "gram": pa.array(np.concatenate([g for g, _ in each]).view(np.int64)),
                "n": pa.array(np.concatenate([n for _, n in each]).astype(np.int64))})


class Tables:
    """The models of all languages as stored tables; ``limits`` has languages and calibration."""

    def __init__(self, counts: DataFrame, langs: list[str], store: Store) -> None:
        self.limits, self.store = Identifier(langs, []), store
        orders = [counts.select("lang", "gram", F.col("n").cast("double").alias("c"))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters to the left
            low = orders[0].groupBy("lang", _low(F.col("gram"), k).alias("gram")).agg(F.count("*").cast("double").alias("c"))
            orders.insert(0, store.keep(low, "lower"))
        self.floors = {r["lang"]: 1.0 / (r["n"] + 1) for r in orders[0].groupBy("lang").agg(F.count("*").alias("n")).collect()}
        self.parts, self.weights = [], []
        for own in orders:
            own = own.withColumn("context", F.shiftrightunsigned("gram", 16))
            sums = store.keep(own.groupBy("lang", "context").agg(
                F.sum("c").alias("total"), (F.sum(F.least("c", F.lit(_DISCOUNT))) / F.sum("c")).alias("weight")), "contexts")
            part = F.greatest(F.col("c") - _DISCOUNT, F.lit(0.0)) / F.col("total")
            self.parts.append(store.keep(own.join(sums, ["lang", "context"]).select("lang", "gram", part.alias("part")), "parts"))
            self.weights.append(sums.select("lang", "context", "weight"))

    def bits(self, kinds: DataFrame) -> DataFrame:
        """(gram, b0, b1, ...): bits of distinct grams under each language."""
        lows = [kinds]
        for k in range(ORDER - 1, 0, -1):
            lows.insert(0, self.store.keep(lows[0].select(_low(F.col("gram"), k).alias("gram")).distinct(), "kinds"))
        p = kinds.sparkSession.createDataFrame(sorted(self.floors.items()), "lang string, p double")
        for k, own in enumerate(lows):
            own = own.withColumn("context", F.shiftrightunsigned("gram", 16))
            own = own.withColumn("low", _low(F.col("gram"), k)).join(p.withColumnRenamed("gram", "low"), "low") if k else own.crossJoin(F.broadcast(p))
            own = own.join(self.weights[k], ["lang", "context"], "left").join(self.parts[k], ["lang", "gram"], "left")
            p = self.store.keep(own.select("lang", "gram", (F.coalesce("weight", F.lit(1.0)) * F.col("p") + F.coalesce("part", F.lit(0.0))).alias("p")), "p")
        return p.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == x, -F.log2("p"))).alias(f"b{i}") for i, x in enumerate(self.limits.langs)])

    def entropies(self, rows: DataFrame) -> DataFrame:
        """(row, size, bits): characters scored, and bits per character, of every text of ``rows`` (row, text) with a letter."""
        with batch_rows(rows.sparkSession, ROWS):
            own = self.store.keep(rows.mapInArrow(_kinds, "row long, gram long, n long"), "grams")
        bits = self.store.keep(self.bits(self.store.keep(own.select("gram").distinct(), "kinds")), "bits")
        sums = [F.sum(F.col("n") * F.col(f"b{i}")) / F.sum("n") for i in range(len(self.limits.langs))]
        return self.store.keep(own.join(bits, "gram").groupBy("row").agg(F.sum("n").alias("size"), F.array(*sums).alias("bits")), "entropies")

    def judge(self, docs: DataFrame, text: Column, carry: list[str]) -> DataFrame:
        """(doc, lang_pred, score, rejected): ``doc`` is a struct of the columns ``carry``."""
        rows = self.store.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), text.alias("text"),
                                           F.monotonically_increasing_id().alias("row")), "rows")
        found = rows.select("doc", "row").join(self.entropies(rows.select("row", "text")), "row", "left").select("doc", "size", "bits")
        limits = self.limits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.array([n or 0 for n in batch.column(1).to_pylist()], np.int64)
                none = [0.0] * len(limits.langs)
                bits = np.array([b or none for b in batch.column(2).to_pylist()]).reshape(len(sizes), len(limits.langs))
                lang, score, reject = limits.decide(sizes, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())],
                    names=["doc", "lang_pred", "score", "rejected"])

        kept = found.select("doc").schema
        return found.mapInArrow(run, kept.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = HELD_GRAMS) -> Identifier | Tables:
    """Counts, models and calibration from the rows that are not held out; tables if there are more than ``held`` grams."""
    spark = docs.sparkSession
    store = Store(spark, "language")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    every = store.keep(rows.groupBy("lang").agg(F.greatest(F.lit(4), F.floor(F.count("*") / CALIBRATION_ROWS)).cast("long").alias("every")), "every")
    rows = rows.join(F.broadcast(every), "lang")  # one row per label
    apart = F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("every")) == 0
    with batch_rows(spark, ROWS):
        counts = (
            rows.where(~apart).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        )
        counts = store.keep(counts, "counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # label values
    sample = rows.where(apart).select("lang", "text")
    if counts.count() > held:
        tables = Tables(counts, langs, store)
        sample = store.keep(sample.withColumn("row", F.monotonically_increasing_id()), "sample")
        seen = tables.entropies(sample.select("row", "text")).join(sample.select("row", "lang"), "row").select("lang", "size", "bits").toArrow()
        _calibrate(tables.limits, seen)
        return tables
    table = counts.toArrow()
    found = np.array(table.column("lang").to_pylist(), dtype=object)
    g = table.column("gram").to_numpy().view(np.uint64)
    n = table.column("n").to_numpy()
    out = Identifier(langs, [kneser_ney(*_sorted(g[found == x], n[found == x])) for x in langs])
    if not langs:
        return out
    # scored where the rows are; only sizes and entropies come back
    shared = spark.sparkContext.broadcast(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = shared.value.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "size": pa.array(sizes), "bits": pa.array(list(bits), pa.list_(pa.float64()))})

    with batch_rows(spark, ROWS):
        seen = sample.mapInArrow(score, "lang string, size long, bits array<double>").toArrow()
    _calibrate(out, seen)
    return out


def _calibrate(model: Identifier, seen: pa.Table) -> None:
    bits = np.array(seen.column("bits").to_pylist()).reshape(-1, len(model.langs))
    model.calibrate(seen.column("lang").to_pylist(), seen.column("size").to_numpy(), bits)


def _sorted(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(g)
    return g[order], n[order]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``ROWS`` rows, so that few texts are held as Python strings."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def identify(docs: DataFrame, model: Identifier | Tables, carry: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``carry`` of ``docs`` with lang_pred, score and rejected."""
    if isinstance(model, Tables):
        return model.judge(docs, F.col(text_col).cast("string"), carry).select(*[F.col(f"doc.`{c}`") for c in carry], "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).cast("string").alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            last = batch.num_columns - 1
            lang, score, reject = shared.value.judge(batch.column(last).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())],
                names=[*carry, "lang_pred", "score", "rejected"])

    kept = docs.drop("text__").schema
    return docs.mapInArrow(run, kept.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))


def filter_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      held: int = HELD_GRAMS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; learns from ``docs`` itself."""
    model = train(docs, id_col, text_col, lang_col, held)
    if isinstance(model, Tables):
        return model.judge(docs, F.col(text_col).cast("string"), docs.columns).where("NOT rejected").select("doc.*")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            _, _, reject = shared.value.judge(batch.column(at).to_pylist())
            yield batch.filter(pa.array(~reject))

    return docs.mapInArrow(run, docs.schema)
