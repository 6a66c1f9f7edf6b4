"""Shapley values of tree ensembles, read off the trees.

The raw score of an ensemble is a sum over leaves.  A leaf counts where every
feature on its path passes: ``o_j`` is 1 if the explained row does, ``z_j`` is
what stands in for an absent feature.  The leaf's share of feature ``i`` is

    value * (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (z_j (1 - t) + o_j t)

(the integral is the Shapley weight summed over all coalitions).  The product is
a polynomial of ``t``, so a Gauss rule with half as many nodes as features is
exact.  Two stand-ins:

* *path*: the share of training rows that follow the path, as counted in the
  nodes when the trees were grown;
* *background*: whether a background row passes, averaged over all of them;
  rows of the background that pass alike are counted together.

Contributions and the base value add up to the row's raw score: the margin of
boosted trees (half the log odds), the probability of a tree or a forest.  Only
the leaves travel to the tasks; rows are explained in Arrow batches where they
are, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelflow.plans.models import ChurnModel
from panelflow.session import materialise, scratch_path

#: Rows that share the work arrays of one leaf.
BLOCK = 4096


class Leaf(NamedTuple):
    """A leaf's weighted value and, per feature of its path, the bounds or categories that pass and their share of rows."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    categories: tuple[frozenset | None, ...]
    share: tuple[float, ...]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Which features of the path pass, as the bits of one number per row of ``x``."""
        out = np.zeros(len(x), np.int64)
        for j, f in enumerate(self.features):
            v = x[:, f]
            ok = np.isin(v, list(self.categories[j])) if self.categories[j] is not None else (v > self.low[j]) & (v <= self.high[j])
            out |= ok.astype(np.int64) << j
        return out


def _walk(nodes: dict[int, Row], value, at: int, path: dict[int, tuple], weight: float) -> Iterator[Leaf]:
    node = nodes[at]
    if node["leftChild"] < 0:
        items = sorted(path.items())
        yield Leaf(weight * value(node), tuple(f for f, _ in items), *(tuple(p[k] for _, p in items) for k in range(4)))
        return
    split = node["split"]
    f, given, kinds = split["featureIndex"], split["leftCategoriesOrThreshold"], split["numCategories"]
    low, high, allowed, share = path.get(f, (float("-inf"), float("inf"), None, 1.0))
    for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
        part = share * nodes[child]["rawCount"] / node["rawCount"]
        if kinds < 0:
            step = (low, min(high, given[0]), allowed, part) if left else (max(low, given[0]), high, allowed, part)
        else:
            chosen = frozenset(given) if left else frozenset(map(float, range(kinds))) - frozenset(given)
            step = (low, high, chosen if allowed is None else allowed & chosen, part)
        yield from _walk(nodes, value, child, path | {f: step}, weight)


def leaves_of(model: ChurnModel) -> list[Leaf]:
    """Leaves of a fitted tree, forest or boosted ensemble, read from its saved node table."""
    fitted = model.model.stages[-1]
    if not hasattr(fitted, "featureImportances"):
        raise ValueError("only trees and ensembles of trees can be read")
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    fitted.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
    else:
        table = table.withColumn("treeID", F.lit(0))
    trees: dict[int, dict[int, Row]] = {}
    for row in table.select("treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "split").collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    boosted = hasattr(fitted, "treeWeights") and "GBT" in type(fitted).__name__
    weights = list(fitted.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    value = (lambda n: n["prediction"]) if boosted else (lambda n: n["impurityStats"][1] / sum(n["impurityStats"]))
    return [leaf for t, nodes in sorted(trees.items()) for leaf in _walk(nodes, value, 0, {}, weights[t])]


def _shares(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley shares of a unit leaf: ``o`` and ``z`` are (..., d); exact by a Gauss rule."""
    d = o.shape[-1]
    nodes, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
    out = np.zeros(np.broadcast_shapes(o.shape, z.shape))
    for t, w in zip((nodes + 1) / 2, weights / 2):
        term = z * (1 - t) + o * t
        before, after = np.ones_like(term), np.ones_like(term)
        np.cumprod(term[..., :-1], axis=-1, out=before[..., 1:])
        after[..., :-1] = np.cumprod(term[..., :0:-1], axis=-1)[..., ::-1]
        out += w * before * after
    return out * (o - z)


def explain(leaves: list[Leaf], x: np.ndarray, background: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(base value, contributions) of the rows of ``x`` (rows x features)."""
    out, base = np.zeros(x.shape), 0.0
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            base += leaf.value
            continue
        bits = np.arange(d)
        if background is None:
            z, counts = np.array([leaf.share]), np.ones(1)
        else:
            kinds, counts = np.unique(leaf.codes(background), return_counts=True)
            z, counts = (kinds[:, None] >> bits & 1).astype(float), counts / len(background)
        base += leaf.value * float(counts @ z.prod(axis=1))
        for a in range(0, len(x), BLOCK):
            codes, back = np.unique(leaf.codes(x[a : a + BLOCK]), return_inverse=True)
            o = (codes[:, None] >> bits & 1).astype(float)
            table = np.zeros(o.shape)
            for row, count in zip(z, counts):
                table += count * _shares(o, row[None, :])
            out[a : a + BLOCK, leaf.features] += leaf.value * table[back]
    return base, out


def encoded(model: ChurnModel, df: DataFrame, key: str) -> DataFrame:
    """(key, x): the feature vector that the trees see, as an array."""
    x = model.encoder.transform(df).withColumns({c: F.col(c).cast("double") for c in model.numeric})
    return PipelineModel(stages=model.model.stages[:-1]).transform(x).select(key, vector_to_array("features").alias("x"))


def tree_attribution(model: ChurnModel, rows: DataFrame, key: str, background: DataFrame | None = None, sample: int = 100, seed: int = 0) -> DataFrame:
    """(key, base, variable, contribution) of every row and variable, for the raw score.

    With ``background``, ``sample`` of its rows (by hash) stand in for absent
    variables; without, the counts of the trees do.  Calibration is a monotone
    map of the raw score and is left out.
    """
    spark = rows.sparkSession
    names = [*model.categorical, *model.numeric]
    held = None
    if background is not None:
        few = background.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample)
        held = np.array([r["x"] for r in encoded(model, few, key).collect()])  # ``sample`` rows
        if not len(held):
            raise ValueError("the background has no rows")
    shared = spark.sparkContext.broadcast((leaves_of(model), held))
    told = materialise(encoded(model, rows, key), "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, stand = shared.value
        for batch in batches:
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(names))
            base, out = explain(leaves, x, stand)
            yield pa.RecordBatch.from_arrays(
                [column, pa.array([base] * len(x)), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(names)).cast(pa.list_(pa.float64()))],
                names=["x", "base", "contributions"])

    # rows that the trees see as equal are explained once
    out = told.join(told.select("x").distinct().mapInArrow(run, "x array<double>, base double, contributions array<double>"), "x")
    label = F.array(*[F.lit(n) for n in names])
    return out.select(key, "base", F.posexplode("contributions").alias("_i", "contribution")).select(
        key, "base", F.get(label, F.col("_i")).alias("variable"), "contribution")
