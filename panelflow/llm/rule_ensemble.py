"""Quality classifier as a sparse rule ensemble.

1. *Statistics.*  Every text becomes a few numbers (sizes, shares of kinds of
   bytes, repetition of words and lines).
2. *Trees.*  A random forest of shallow trees is grown on labelled rows.
3. *Rules.*  Every path from a root to a node is a conjunction of bounds on
   statistics; equal ones count once.
4. *Lasso.*  A logistic regression with an L1 penalty weighs the rules, most of
   them zero; the penalty is the one of ``PENALTIES`` with the least log loss on
   a part of the labelled rows that neither trees nor weights have seen.
5. *Compile.*  The rules that are left become one Spark column expression over
   the statistics, so a table is scored without Python.

``SAMPLE`` bounds the labelled rows that train (chosen by a hash of their id);
everything else covers all rows.  Scores are probabilities of label 1.

Defined results: null and empty texts have statistics of zero and a score like
any other.  Labelled ids without a document, documents without a label and null
labels train nothing; a repeated id trains with each of its rows.  Without
labels of both kinds the score is the same for all, the smoothed share of label
1.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import Store

#: Labelled rows of either label that train, about.
SAMPLE = 12_000
TREES = 24
DEPTH = 3
PENALTIES = (0.01, 0.002)
ITERATIONS = 40
#: Training rows below a node, so that a rule must hold for.
SUPPORT = 12
OUT_ROWS = 2000

FEATURES = (
    "log_words", "word_bytes", "letters", "capitals", "digits", "symbols", "marks", "shouts", "controls", "spaces", "distinct_words",
    "top_word", "doubled_words", "bare_marks", "marked_words", "repeated_pairs", "repeated_lines", "line_words", "sentence_words", "byte_entropy", "long_words",
)

#: Words without letters and digits, and words with marks that prose hardly has.
_BARE = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+\Z").match
_MARKED = re.compile(rb"[#*$%&|<>{}\[\]\\^~_=+@/!?]").search
_KINDS = np.zeros((256, 8))
for _c in range(256):
    _char = chr(_c)
    _KINDS[_c, 0] = _c >= 128 or _char.isalpha()
    _KINDS[_c, 1] = 65 <= _c <= 90
    _KINDS[_c, 2] = 48 <= _c <= 57
    _KINDS[_c, 3] = _c < 128 and _char in "#*$%&|<>{}[]\\^~_=+@/"
    _KINDS[_c, 4] = _c < 128 and _char in ".,;:'\"()-"
    _KINDS[_c, 5] = _c < 128 and _char in "!?"
    _KINDS[_c, 6] = _c in (127, *range(9), *range(14, 32))
    _KINDS[_c, 7] = _c in (9, 10, 11, 12, 13, 32)


def statistics(text: bytes) -> list[float]:
    """``FEATURES`` of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ _KINDS / len(text)
    known = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = Counter(x for x in map(bytes.strip, text.split(b"\n")) if x)
    n_lines = lines.total()
    used = counts[counts > 0] / len(text)
    ends = int(counts[33] + counts[46] + counts[63])
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)), float(sizes.mean()), float(shares[0]), float(shares[1] / shares[0]) if shares[0] else 0.0, *map(float, shares[2:]),
        len(known) / n, max(known.values()) / n, sum(map(eq, words, words[1:])) / n, sum(map(known.get, filter(_BARE, known))) / n,
        sum(map(known.get, filter(_MARKED, known))) / n, 1 - len(pairs) / (n - 1) if n > 1 else 0.0, 1 - len(lines) / n_lines,
        n / n_lines, n / (ends + 1), float(-(used * np.log2(used)).sum()), float((sizes > 24).mean()),
    ]


def with_statistics(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` of every row and its statistics, as columns."""
    rows = docs.select(*keys, F.col(text_col).cast("string").alias("text__"))
    schema = rows.drop("text__").schema
    for name in FEATURES:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).cast(pa.binary())
            for a in range(0, batch.num_rows, OUT_ROWS):
                part = texts.slice(a, OUT_ROWS)
                values = np.array([statistics(t.as_py() or b"") for t in part]).reshape(len(part), len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, OUT_ROWS) for i in range(len(keys))] + [pa.array(values[:, j]) for j in range(len(FEATURES))],
                    names=[*keys, *FEATURES])

    return rows.mapInArrow(run, schema)


class Rule(NamedTuple):
    """Statistic bounds ``low < value <= high``, all of which hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        tests = []
        for name, low, high in self.bounds:
            if low > float("-inf"):
                tests.append(F.col(name) > low)
            if high < float("inf"):
                tests.append(F.col(name) <= high)
        return reduce(Column.__and__, tests)

    def __str__(self) -> str:
        return " and ".join(f"{low:g} < {name} <= {high:g}" for name, low, high in self.bounds)


class Ensemble(NamedTuple):
    """Weighted rules; ``intercept`` is the log odds where none holds."""

    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        odds = reduce(Column.__add__, [F.when(r.column(), w).otherwise(0.0) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-odds))


def _paths(node, bounds: dict[str, tuple[float, float]]) -> Iterator[Rule]:
    """Rules of all nodes below ``node`` (a node of a Spark tree)."""
    if bounds:
        yield Rule(tuple(sorted((n, *b) for n, b in bounds.items())))
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, at = FEATURES[split.featureIndex()], split.threshold()
    low, high = bounds.get(name, (float("-inf"), float("inf")))
    yield from _paths(node.leftChild(), bounds | {name: (low, min(high, at))})
    yield from _paths(node.rightChild(), bounds | {name: (max(low, at), high)})


def extract_rules(forest) -> list[Rule]:
    """Distinct rules of a fitted tree ensemble, in a fixed order."""
    return sorted({rule for tree in forest.trees for rule in _paths(tree._java_obj.rootNode(), {})})


def _binary(rules: list[Rule]) -> Column:
    return array_to_vector(F.array(*[F.when(r.column(), 1.0).otherwise(0.0) for r in rules]))


def fit(rows: DataFrame, store: Store, seed: int = 5) -> Ensemble:
    """Ensemble from ``rows`` with all statistics, a ``label`` of 0.0 or 1.0 and a stable ``part`` in 0..9."""
    rows = store.keep(rows.coalesce(4), "labelled")  # about 2 * SAMPLE rows
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    no, yes = found.get(0.0, 0), found.get(1.0, 0)
    constant = Ensemble([], float(np.log((yes + 1) / (no + 1))))
    if not no or not yes:
        return constant
    learn, tune = rows.where("part < 8"), rows.where("part >= 8")
    if learn.select("label").distinct().count() < 2:
        return constant
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInfoGain=1e-4, minInstancesPerNode=SUPPORT, featureSubsetStrategy="onethird", seed=seed,
    ).fit(learn.select("label", array_to_vector(F.array(*FEATURES)).alias("x")))
    rules = extract_rules(forest)
    if not rules:
        return constant
    learn, tune = (store.keep(d.select("label", _binary(rules).alias("x")), "rules") for d in (learn, tune))
    best, least = None, float("inf")
    for penalty in PENALTIES:
        model = LogisticRegression(featuresCol="x", labelCol="label", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=ITERATIONS).fit(learn)
        weights = [(r, float(w)) for r, w in zip(rules, model.coefficients) if w]
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.get(F.col("p"), F.lit(1))))
        loss = (
            model.transform(tune).select("label", vector_to_array("probability").alias("p"))
            .agg(F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p)))).first()[0]
        )
        if loss is None or loss < least:
            best, least = Ensemble(weights, float(model.intercept)), loss if loss is not None else least
    return best


def train(found: DataFrame, labels: DataFrame, label_col: str, store: Store, id_col: str = "doc_id", allowed: Column | None = None) -> Ensemble:
    """Ensemble from the statistics ``found`` (id and ``FEATURES``) and ``labels`` (id, 0 or 1) where ``allowed`` holds."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col(id_col).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1_000_000))
    cut = [F.when(F.col("label") == v, min(1.0, SAMPLE / max(1, sizes.get(v, 0))) * 1_000_000).otherwise(0.0) for v in (0.0, 1.0)]
    chosen = known.where(place < cut[0] + cut[1]).dropDuplicates([id_col])
    rows = found.join(F.broadcast(chosen), id_col)  # about 2 * SAMPLE rows at most
    return fit(rows.select("label", *FEATURES, F.pmod(F.xxhash64(F.lit("part"), id_col), F.lit(10)).alias("part")), store)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
             allowed: Column | None = None) -> DataFrame:
    """(id, score, predicted) of every row of ``docs``; labels of ids where ``allowed`` (over the id) fails are not looked at."""
    store = Store(docs.sparkSession, "rules")
    found = store.keep(with_statistics(docs, [id_col], text_col), "statistics")
    model = train(found, labels, label_col, store, id_col, allowed)
    score = model.score()
    return found.select(id_col, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
