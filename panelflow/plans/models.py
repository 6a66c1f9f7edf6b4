"""Spark ML pipelines: encoding, estimators, calibration and their use."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.text import match_key, match_key_no_zeros
from panelflow.operators.clean import (
    check_unmatched, clip_to_ranges, remap_categories, require_columns,
)
from panelflow.operators.evaluate import metrics_from_values, ranking_metrics
from panelflow.operators.ordered import row_numbers, value_table
from panelflow.session import materialise

REST, MISSING, UNKNOWN = "(rest)", "(missing)", "(unknown)"
CLIP = 1e-6  # fixed value: calibrated probabilities stay inside (0, 1)
SCORE_DIGITS = 6
#: Models fitted at the same time.
TOGETHER = 4
#: Cells that one task of a fit holds at least; fewer make one task.
CELLS = 25_000


@dataclass
class RareCategories:
    """Folds rare categories into one drawer; null is missing, values not seen in training get ``unknown``.

    Keeps at most ``max_categories - 1`` frequent values when there are more;
    only these reach the driver.  The rare ones stay a table, and a column that
    has any meets it in a join.
    """

    columns: Sequence[str]
    max_categories: int = 254
    min_frequency: int = 10
    kept: dict[str, list[str]] = field(default_factory=dict)
    rare: dict[str, DataFrame] = field(default_factory=dict)
    unknown: str = MISSING

    def fit(self, train: DataFrame) -> RareCategories:
        for c in self.columns:
            freq = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
            freq = materialise(freq, "categories")
            rows = freq.orderBy(F.desc("n"), "v").limit(self.max_categories + 1).collect()
            slots = self.max_categories - 1 if len(rows) > self.max_categories else len(rows)
            self.kept[c] = [r["v"] for r in rows[:slots] if r["n"] >= self.min_frequency]
            rare = freq.where(~F.col("v").isin(self.kept[c])).select(F.col("v").alias(f"_rare_{c}"))
            if not rare.isEmpty():
                self.rare[c] = rare
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def fold(c):
            v = F.col(c).cast("string")
            e = F.when(v.isNull(), MISSING).when(v.isin(self.kept[c]), v)
            if c in self.rare:
                e = e.when(F.col(f"_rare_{c}").isNotNull(), REST)
            return e.otherwise(self.unknown)

        names = df.columns
        for c, rare in self.rare.items():
            df = df.join(rare, df[c].cast("string") == rare[f"_rare_{c}"], "left")
        return df.select(*names, *[fold(c).alias(f"{c}_cat") for c in self.columns])


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], linear: bool) -> list:
    """Imputed (and for linear models scaled, one-hot) feature vector."""
    stages, inputs = [], []
    if categorical:
        names = [f"{c}_idx" for c in categorical]
        stages.append(StringIndexer(inputCols=[f"{c}_cat" for c in categorical], outputCols=names, handleInvalid="keep"))
        if linear:
            hot = [f"{c}_hot" for c in categorical]
            stages.append(OneHotEncoder(inputCols=names, outputCols=hot, handleInvalid="keep"))
            names = hot
        inputs += names
    if numeric:
        filled = [f"{c}_num" for c in numeric]
        stages.append(Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"))
        if linear:
            stages.append(VectorAssembler(inputCols=filled, outputCol="numeric_raw"))
            stages.append(StandardScaler(inputCol="numeric_raw", outputCol="numeric_std", withMean=True))
            filled = ["numeric_std"]
        inputs += filled
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def classifier(kind: str, seed: int = 0, **params):
    """Estimator by technique; ``params`` override the defaults (fixed values).

    Boosting stops early: when the held-out loss no longer falls.
    """
    base = {"featuresCol": "features", "labelCol": "target"}
    if kind == "logistic":
        return LogisticRegression(**{**base, "maxIter": 2000, "weightCol": "weight", **params})
    tree = {**base, "maxBins": 256, "seed": seed}
    if kind == "tree":
        return DecisionTreeClassifier(**{**tree, "maxDepth": 8, "minInstancesPerNode": 300, **params})
    if kind == "forest":
        return RandomForestClassifier(
            **{**tree, "numTrees": 300, "maxDepth": 16, "minInstancesPerNode": 50, "featureSubsetStrategy": "sqrt", **params}
        )
    boosted = {**tree, "maxIter": 300, "stepSize": 0.06, "maxDepth": 6, "minInstancesPerNode": 200, "validationIndicatorCol": "held_out",
               "validationTol": 0.0}
    if kind == "boosting":
        return GBTClassifier(**{**boosted, **params})
    if kind == "stochastic boosting":
        return GBTClassifier(
            **{**boosted, "maxIter": 400, "stepSize": 0.05, "minInstancesPerNode": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", **params}
        )
    raise ValueError(f"unknown technique {kind!r}")


def prepare(df: DataFrame, numeric: Sequence[str], balanced: bool = False, seed: int = 0) -> DataFrame:
    """Doubles for the features, class weights and the 15 % early-stop mark."""
    out = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    out = out.withColumn("target", F.col("target").cast("double"))
    out = out.withColumn("held_out", F.pmod(F.xxhash64("id", "cohort", F.lit(seed)), F.lit(100)) < 15)
    weight = F.lit(1.0)
    if balanced:
        rate = df.agg(F.avg("target")).scalar()
        weight = F.when(F.col("target") == 1, 0.5 / rate).otherwise(0.5 / (1 - rate))
    return out.withColumn("weight", weight)


def merged(df: DataFrame, columns: Sequence[str], **sums) -> DataFrame:
    """One row per distinct combination of ``columns`` (a cell), with ``n``, its rows, and further ``sums``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def training_cells(x: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Encoded rows as cells of equal features, target and early-stop mark, stored: a fit weighs a cell by its rows.

    The same fit as on the rows, at the cost of the combinations that occur.
    """
    columns = [*[f"{c}_cat" for c in categorical], *numeric]
    cells = merged(x, [*columns, "target", "held_out"], weight=F.col("weight"))
    return few_tasks(materialise(cells.withColumn("cell", F.xxhash64(*columns, "target", "held_out")), "cells"))


def few_tasks(stored: DataFrame) -> DataFrame:
    """A stored table in tasks of no less than ``CELLS`` rows, for fits that read it hundreds of times."""
    return stored.coalesce(max(1, math.ceil(stored.count() / CELLS)))


def smallest_nodes(params: Mapping, total: float) -> dict:
    """``params`` with the least number of rows of a node as a least share of ``total``, which counts rows and not cells."""
    least = params["minInstancesPerNode"]
    out = {**params, "minInstancesPerNode": 1}
    if least > 1:  # half a row of room for rounding: weights of nodes are whole numbers
        out.update({"maxDepth": 0} if 2 * least > total else {"minWeightFractionPerNode": (least - 0.5) / total})
    return out


def by_rows(kind: str, params: Mapping) -> bool:
    """Boosting that leaves rows out at random needs the rows one by one."""
    given = classifier(kind, **params)
    return isinstance(given, GBTClassifier) and given.getSubsamplingRate() < 1


def encoded_cells(stages: PipelineModel, cells: DataFrame) -> DataFrame:
    return stages.transform(cells).select("target", "held_out", "weight", "n", "cell", "features")


def fit_cells(cells: DataFrame, kind: str, seed: int = 0, **params):
    """Fit an estimator on (target, held_out, weight, n, cell, features)."""
    if kind == "logistic":
        return classifier(kind, seed, **params).fit(cells)
    if kind == "forest":
        return fit_forest(cells, seed, **params)
    given = classifier(kind, seed, **params)
    mark = given.getOrDefault("validationIndicatorCol") if kind != "tree" and given.isDefined("validationIndicatorCol") else None
    total = (cells if mark is None else cells.where(~F.col(mark))).agg(F.sum("n")).first()[0] or 0.0
    least = smallest_nodes({**params, "minInstancesPerNode": given.getMinInstancesPerNode()}, total)
    return classifier(kind, seed, **least, weightCol="n").fit(cells)


def fit_forest(cells: DataFrame, seed: int = 0, **params) -> RandomForestClassificationModel:
    """Random forest: every tree grows on its own bootstrap sample of the rows.

    A cell of n rows counts Poisson(n) times in a tree, the sum of n draws of
    the Poisson(1) that a row gets; the draws come from a generator keyed by the
    cell.  Trees grow side by side, each from its own column of draws.
    """
    given = classifier("forest", seed, **params)
    trees, rate = given.getNumTrees(), given.getSubsamplingRate()
    drawn = with_draws(cells.select("target", "cell", "n", vector_to_array("features").alias("x")), "cell", "n", trees, rate, seed)
    drawn = few_tasks(materialise(drawn.drop("cell", "n"), "draws"))
    drawn = drawn.withColumns({"target": F.col("target"), "features": array_to_vector("x")}).withMetadata(
        "target", {"ml_attr": {"type": "nominal", "num_vals": 2}}).withMetadata("features", cells.schema["features"].metadata)
    totals = drawn.agg(*[F.sum(f"_w{i}").cast("double") for i in range(trees)]).first()
    rng = random.Random(seed)
    seeds = [rng.randrange(1 << 31) for _ in range(trees)]

    def grow(i: int):
        sample = drawn.where(F.col(f"_w{i}") > 0).select("target", "features", F.col(f"_w{i}").cast("double").alias("_n"))
        least = smallest_nodes({**params, "minInstancesPerNode": given.getMinInstancesPerNode()}, totals[i] or 0.0)
        one = {**least, "numTrees": 1, "bootstrap": False, "subsamplingRate": 1.0, "weightCol": "_n"}
        return classifier("forest", seeds[i], **one).fit(sample)._java_obj.trees()[0]

    spark = cells.sparkSession
    with ThreadPool(max(TOGETHER, min(16, spark.sparkContext.defaultParallelism))) as pool:
        grown = pool.map(grow, range(trees), chunksize=1)
    gateway, ml = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml.classification
    array = gateway.new_array(ml.DecisionTreeClassificationModel, trees)
    for i, tree in enumerate(grown):
        array[i] = tree
    model = RandomForestClassificationModel(ml.RandomForestClassificationModel(given.uid, array, grown[0].numFeatures(), 2))
    given._copyValues(model._resetUid(given.uid))
    model._transfer_params_to_java()
    return model


def with_draws(df: DataFrame, key: str, count: str, replicates: int, rate: float, seed: int) -> DataFrame:
    """``df`` with columns ``_w0``, ``_w1``, ...: Poisson(rate * count) draws of a row, keyed by ``key``."""
    names = [*df.columns, *[f"_w{i}" for i in range(replicates)]]
    kinds = T.StructType([*df.schema.fields, *[T.StructField(f"_w{i}", T.IntegerType()) for i in range(replicates)]])
    k, c, mask = df.columns.index(key), df.columns.index(count), (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(k).to_pylist(), batch.column(c).to_pylist())
            drawn = [np.random.Generator(np.random.Philox(key=[a & mask, seed & mask])).poisson(rate * n, replicates) for a, n in rows]
            table = np.array(drawn, np.int32).reshape(batch.num_rows, replicates)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(table[:, i]) for i in range(replicates)]], names=names)

    return df.mapInArrow(run, kinds)


@dataclass
class ChurnModel:
    """Fitted encoder, pipeline and optional calibration."""

    encoder: RareCategories
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    calibration: object = None

    def raw(self, df: DataFrame, out: str = "raw") -> DataFrame:
        """Uncalibrated probability of every row; only ``out`` is added."""
        x = self.encoder.transform(df).withColumns({f"_keep_{c}": F.col(c) for c in self.numeric})
        x = x.withColumns({c: F.col(c).cast("double") for c in self.numeric})
        scored = self.model.transform(x).withColumn(out, vector_to_array("probability")[1])
        keep = [F.col(f"_keep_{c}").alias(c) if c in self.numeric else F.col(c) for c in df.columns]
        return scored.select(*keep, out)

    def calibrate(self, validation: DataFrame) -> ChurnModel:
        """Isotonic curve on validation scores.

        Scores are first merged to their distinct rounded values with weights,
        so the pooled sequence is bounded by the rounding, not by the rows.
        """
        v = self.raw(self.cells(validation)).select(F.round("raw", SCORE_DIGITS).alias("raw"), "target", "n")
        cells = v.groupBy("raw").agg((F.sum(F.col("target") * F.col("n")) / F.sum("n")).alias("target"), F.sum("n").alias("weight"))
        iso = IsotonicRegression(featuresCol="raw", labelCol="target", weightCol="weight", predictionCol="p")
        self.calibration = iso.fit(cells)
        return self

    def score_once(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``score`` for tables with many equal rows: each combination of features is scored once and meets its rows in a join."""
        names = [*self.categorical, *self.numeric]
        kinds = materialise(self.score(df.select(*names).distinct(), out), "kinds").withColumnsRenamed({c: f"_k_{c}" for c in names})
        same = [df[c].eqNullSafe(kinds[f"_k_{c}"]) for c in names]
        return df.join(kinds, reduce(Column.__and__, same), "left").select(*df.columns, out)

    def cells(self, df: DataFrame) -> DataFrame:
        """Rows of equal features and target as one, with their number ``n``: what measures of the scores need to score."""
        return merged(df.withColumn("target", F.col("target").cast("double")), [*self.categorical, *self.numeric, "target"])

    def metrics(self, df: DataFrame) -> DataFrame:
        """Ranking metrics of the scores of ``df``."""
        return ranking_metrics(self.score(self.cells(df)), "target", "p", weight="n")

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Calibrated probability of every row (the raw one without calibration); only ``out`` is added."""
        if self.calibration is None:
            return self.raw(df, out)
        curve = self.calibration.copy({self.calibration.featuresCol: "_raw", self.calibration.predictionCol: "_calibrated"})
        p = curve.transform(self.raw(df, "_raw"))
        return p.withColumn(out, F.least(F.greatest(F.col("_calibrated"), F.lit(CLIP)), F.lit(1 - CLIP))).drop("_raw", "_calibrated")


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], kind: str = "boosting", seed: int = 0,
        balanced: bool = False, max_categories: int = 254, min_frequency: int | None = None, **params) -> ChurnModel:
    linear = kind == "logistic"
    if min_frequency is None:
        min_frequency = 50 if linear else 10
    encoder = RareCategories(categorical, max_categories, min_frequency, unknown=UNKNOWN if linear else MISSING).fit(train)
    x = encoder.transform(prepare(train, numeric, balanced, seed))
    if linear and "regParam" not in params:
        params = {**params, "regParam": 1.0 / max(1, x.count())}  # the inverse penalty 1 of a sum of losses
    stages = Pipeline(stages=feature_stages(numeric, categorical, linear=linear)).fit(x)  # medians, orders and scales are those of the rows
    if by_rows(kind, params):
        fitted = classifier(kind, seed, **params).fit(stages.transform(x))
    else:
        fitted = fit_cells(encoded_cells(stages, training_cells(x, numeric, categorical)), kind, seed, **params)
    return ChurnModel(encoder, PipelineModel(stages=[*stages.stages, fitted]), list(numeric), list(categorical))


@dataclass
class TrainingProfile:
    """What scoring checks new rows against: numeric ranges and the categories seen in training."""

    ranges: dict[str, tuple]
    categories: DataFrame  # column, canonical, key1, key2

    @classmethod
    def of(cls, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> TrainingProfile:
        """One pass: the ranges are observed while the distinct categories are written."""
        seen = Observation()
        ends = [f(F.col(c).cast("double")).alias(f"{c}_{k}") for c in numeric for k, f in (("lo", F.min), ("hi", F.max))]
        watched = train.observe(seen, F.count(F.lit(1)).alias("_n"), *ends)
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("canonical")) for c in categorical])
        if not categorical:
            pairs = F.array(F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("canonical")))
        kinds = watched.select(F.explode(pairs).alias("p")).where("p.canonical IS NOT NULL").select("p.*").distinct()
        kinds = materialise(kinds.withColumn("key1", match_key("canonical")).withColumn("key2", match_key_no_zeros("canonical")), "profile")
        found = seen.get
        return cls({c: (found.get(f"{c}_lo"), found.get(f"{c}_hi")) for c in numeric}, kinds)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Categories in their training form (``<c>_unmatched`` marks unknown ones), numbers clipped, ``warnings`` as an array.

        Joins with the static table of categories and constants only, so ``df`` may be a stream.
        """
        columns = [r["column"] for r in self.categories.select("column").distinct().collect()]
        for c in columns:
            if c in df.columns:
                df = remap_categories(df, self.categories.where(F.col("column") == c).drop("column"), c)
        df = df.withColumns({c: F.col(c).cast("double") for c in self.ranges})
        return clip_to_ranges(df, self.ranges, list(self.ranges))


def checked_score(model: ChurnModel, df: DataFrame, train: DataFrame | TrainingProfile, out: str = "p") -> DataFrame:
    """Batch scoring with its checks: columns, category forms, unmatched shares, training ranges.

    Categories are rewritten in their training form; too many without one stop
    the run.  Numbers are clipped to the training range; ``warnings`` names the
    clipped ones, separated by commas.
    """
    require_columns(df.columns, [*model.categorical, *model.numeric])
    profile = train if isinstance(train, TrainingProfile) else TrainingProfile.of(train, model.numeric, model.categorical)
    ready = materialise(profile.prepare(df), "remapped")  # checked, then scored
    check_unmatched(ready, [c for c in model.categorical if f"{c}_unmatched" in ready.columns])
    ready = ready.select(*df.columns, F.array_join("warnings", ",").alias("warnings"))
    return model.score_once(ready, out)


def score_requests(model: ChurnModel, requests: DataFrame, profile: TrainingProfile, out: str = "p") -> DataFrame:
    """Requests one by one, with the checks of ``checked_score``: an unknown category rejects its own request.

    ``requests`` may be a stream.  ``errors`` (an array, kept if it is there)
    gains one entry per unknown category; rejected requests have no score.
    """
    require_columns(requests.columns, [*model.categorical, *model.numeric])
    before = F.col("errors") if "errors" in requests.columns else F.array().cast("array<string>")
    ready = profile.prepare(requests)
    unknown = [F.when(F.col(f"{c}_unmatched"), F.lit(f"unknown {c}")) for c in model.categorical if f"{c}_unmatched" in ready.columns]
    errors = F.array_distinct(F.concat(before, F.array_compact(F.array(*unknown)))) if unknown else before
    ready = ready.withColumn("errors", errors).select(*[c for c in requests.columns if c != "errors"], "errors", "warnings")
    return model.score(ready, out).withColumn(out, F.when(F.size("errors") == 0, F.col(out)))


def evaluate_candidates(train: DataFrame, validation: DataFrame, test: DataFrame,
                        candidates: Mapping[str, tuple[list[str], list[str]]], kind: str = "boosting", **params):
    """Fit, calibrate and measure every feature set; returns (table, scored).

    ``scored`` has one probability column per candidate (``p0``, ``p1``, ...).
    """
    scored, names, table = test, [], None
    with ThreadPool(TOGETHER) as pool:
        fitted = pool.map(lambda c: fit(train, *c, kind, **params).calibrate(validation), candidates.values())
    for i, (m, (name, (num, cat))) in enumerate(zip(fitted, candidates.items())):
        scored = m.score(scored, f"p{i}")
        names.append((f"p{i}", name, len(num) + len(cat)))
    scored = materialise(scored, "candidates")  # every metric reads these probabilities
    for col, name, n_vars in names:
        row = ranking_metrics(scored, "target", col).withColumn("model", F.lit(name)).withColumn("n_vars", F.lit(n_vars))
        table = row if table is None else table.unionByName(row)
    return table, scored


def ablation(train: DataFrame, validation: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
             blocks: Mapping[str, Sequence[str]], kind: str = "boosting", **params) -> DataFrame:
    """AUC with each block of variables removed, against the full model."""
    out, variants = None, {"(complete)": [], **blocks}
    sets = [([c for c in numeric if c not in r], [c for c in categorical if c not in r]) for r in variants.values()]
    with ThreadPool(TOGETHER) as pool:
        fitted = pool.map(lambda c: fit(train, *c, kind, **params), sets)
    for name, m in zip(variants, fitted):
        row = ranking_metrics(m.raw(m.cells(validation)), "target", "raw", weight="n").select(F.lit(name).alias("removed"), "auc", "lift", "brier")
        out = row if out is None else out.unionByName(row)
    full = out.where("removed = '(complete)'").select("auc").scalar()
    return out.withColumn("auc_change", F.col("auc") - full)


def permutation_importance(model: ChurnModel, df: DataFrame, key: str = "row_id", repeats: int = 3, seed: int = 0) -> DataFrame:
    """Fall of AUC and lift when one variable is shuffled.

    Rows get a random global order; repeat k takes the value of the row a
    seeded distance further on, a join on the position.  All shuffled
    variables come from that one join, and every variant is measured in one
    grouped ranking table.
    """
    variables = [*model.categorical, *model.numeric]
    base = df.select(key, "target", *variables)
    placed = row_numbers(base.withColumn("_h", F.xxhash64(key, F.lit(seed))), ["_h", key], "_rn").drop("_h")
    total = placed.agg(F.count("*")).scalar()
    placed = placed.withColumn("_n", total)
    rng = random.Random(seed)
    variants = model.raw(model.cells(base)).select(F.lit("(none)").alias("variable"), F.lit(0).alias("repeat"), "target", "n", "raw")
    for k in range(repeats):
        step = rng.uniform(0.1, 0.9)
        away = placed.select(
            (F.pmod(F.col("_rn") - 1 + F.floor(F.col("_n") * step), F.col("_n")) + 1).alias("_rn"),
            *[F.col(v).alias(f"_s_{v}") for v in variables],
        )
        both = placed.join(away, "_rn")
        # one join and one scoring for all variables: each row comes once with each variable exchanged
        each = both.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in variables])))
        shuffled = each.select(
            key, "target", "variable",
            *[F.when(F.col("variable") == c, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in variables])
        cells = merged(shuffled, ["variable", *variables, "target"])  # equal rows are scored once
        variants = variants.unionByName(model.raw(cells).select("variable", F.lit(k).alias("repeat"), "target", "n", "raw"))
    values = value_table(
        variants.withColumn("p", F.round("raw", SCORE_DIGITS)), "p",
        {"n": F.col("n").cast("long"), "pos": (F.col("target") * F.col("n")).cast("long")}, ["variable", "repeat"],
    )
    m = metrics_from_values(values, ["variable", "repeat"]).select("variable", "repeat", "auc", "lift")
    none = m.where("variable = '(none)'")
    auc0, lift0 = none.select("auc").scalar(), none.select("lift").scalar()
    return m.where("variable <> '(none)'").withColumn("_a", auc0).withColumn("_l", lift0).groupBy("variable").agg(
        F.avg(F.col("_a") - F.col("auc")).alias("auc_fall"), F.avg(F.col("_l") - F.col("lift")).alias("lift_fall")
    )


def shapley_attribution(model: ChurnModel, rows: DataFrame, background: DataFrame, key: str, permutations: int = 20, seed: int = 0,
                        sample: int = 100) -> DataFrame:
    """Monte-Carlo Shapley values of the calibrated score of a sample of rows, as one scoring job.

    Every (row, permutation) is paired with one of ``sample`` background rows, in
    turn from a place that depends on the row; the row's values enter in permutation order and each prefix is scored once.  Per row
    and permutation the contributions add up to p(row) - p(background).  Raw
    scores of trees have exact values in ``plans.attribution``.
    """
    variables = [*model.categorical, *model.numeric]
    m = len(variables)
    rng = random.Random(seed)
    orders = [rng.sample(range(m), m) for _ in range(permutations)]
    few = background.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample)
    numbered = few.select(F.collect_list(F.struct(*[F.col(v) for v in variables]))).scalar()
    draws = F.array(*[F.struct(F.lit(i).alias("perm"), F.array(*[F.lit(o) for o in order]).alias("order")) for i, order in enumerate(orders)])
    x = rows.select(key, *variables).withColumn("_bg", numbered).withColumn("_d", F.explode(draws))
    x = x.withColumn("_b", F.element_at("_bg", F.pmod(F.xxhash64(key) + F.col("_d.perm"), F.size("_bg")).cast("int") + 1))
    x = x.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(m))))
    first = F.slice("_d.order", 1, F.col("step"))
    cols = [
        F.when(F.array_contains(F.when(F.col("step") > 0, first).otherwise(F.array().cast("array<int>")), i), F.col(v))
        .otherwise(F.col(f"_b.{v}")).alias(v)
        for i, v in enumerate(variables)
    ]
    added = F.when(F.col("step") > 0, F.element_at("_d.order", F.greatest(F.col("step"), F.lit(1))))
    coalitions = x.select(key, F.col("_d.perm").alias("perm"), "step", added.alias("added"), *cols)
    scored = model.score(coalitions, "_p").select(key, "perm", F.struct("step", "added", "_p").alias("s"))
    # the prefixes of one (row, permutation) in order: each step's gain is the difference to the one before
    chains = scored.groupBy(key, "perm").agg(F.array_sort(F.collect_list("s")).alias("c"))
    gains = chains.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: F.struct(
        F.get("c", i)["added"].alias("added"), (F.get("c", i)["_p"] - F.get("c", i - 1)["_p"]).alias("gain")))).alias("g"))
    names = F.array(*[F.lit(v) for v in variables])
    return gains.groupBy(key, F.get(names, F.col("g.added")).alias("variable")).agg(F.avg("g.gain").alias("contribution"))


def coefficients(model: ChurnModel, top: int = 8) -> DataFrame:
    """Largest positive and negative coefficients of a linear model.

    The names are the attribute names of the feature vector (metadata).
    """
    fitted = model.model.stages[-1]
    spark = SparkSession.getActiveSession()
    indexer = next((s for s in model.model.stages if hasattr(s, "labelsArray")), None)
    names: list[str] = []
    if indexer is not None:
        for c, labels in zip(model.categorical, indexer.labelsArray):
            names += [f"{c}={v}" for v in labels] + [f"{c}=(other)"]
    names += list(model.numeric)
    values = [float(v) for v in fitted.coefficients]
    if len(names) < len(values):  # one-hot keeps one more slot per column
        names += [f"slot {i}" for i in range(len(names), len(values))]
    ranked = sorted(zip(names, values), key=lambda t: (t[1], t[0]))
    rows = ranked[:top] + ranked[-top:]
    return spark.createDataFrame(sorted(set(rows)), "variable string, coefficient double")


def time_techniques(train: DataFrame, test: DataFrame, numeric, categorical, kinds: Mapping[str, dict]) -> DataFrame:
    """Fit seconds and scoring milliseconds per 1,000 rows."""
    rows = []
    n = test.count()
    for kind, params in kinds.items():
        t = time.perf_counter()
        m = fit(train, numeric, categorical, kind, **params)
        fitted = time.perf_counter() - t
        t = time.perf_counter()
        m.raw(test).agg(F.sum("raw")).first()
        rows.append((kind, fitted, (time.perf_counter() - t) * 1e6 / max(n, 1)))
    return train.sparkSession.createDataFrame(rows, "technique string, fit_seconds double, predict_ms_per_1000 double")


def fit_area_regressor(train: DataFrame, columns: Sequence[str], kind: str, label: str = "objective", **params) -> PipelineModel:
    """Linear (imputed, scaled) or boosted regression on the area panel."""
    filled = [f"{c}_f" for c in columns]
    stages = [
        Imputer(inputCols=list(columns), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
    ]
    if kind == "linear":
        stages += [
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
            LinearRegression(featuresCol="features", labelCol=label, **params),
        ]
    else:
        stages.append(
            GBTRegressor(**{"featuresCol": "raw_features", "labelCol": label, "maxIter": 200, "stepSize": 0.06, "maxDepth": 4,
                            "minInstancesPerNode": 15, "seed": 0, **params})
        )
    return Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()))


def area_baselines(df: DataFrame, train: DataFrame, label: str = "objective") -> DataFrame:
    """Historical mean and persistence, filled with the training mean."""
    mean = train.agg(F.avg(label)).scalar()
    return df.withColumn("_m", mean).withColumn("p_mean", F.coalesce("churn_mean", "_m")).withColumn(
        "p_persist", F.coalesce("churn_previous", "_m")
    ).drop("_m")


def random_baseline(df: DataFrame, key: str, seed: int = 0, out: str = "p_random") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000)
