"""Fuzzy label identity.

Every *distinct* pair of labels is judged once.  The cheap tests of the
identity rule are columns; only pairs they leave undecided reach the Arrow
function with the Ratcliff-Obershelp ratio, which Spark has no built-in for.
"""

from __future__ import annotations

from collections.abc import Sequence

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.text import core_tokens, is_placeholder

# Fixed values of the identity rule.
JOINED_RATIO = 0.90
TOKEN_RATIO = 0.82
TOKEN_SHARE = 0.6
FIRST_VERSION_RATIO = 0.85


def _at_least(a: str, b: str, threshold: float) -> bool:
    """ratio(a, b) >= threshold, trying the cheap upper bounds first."""
    shorter, longer = sorted((len(a), len(b)))
    if 2.0 * shorter < threshold * (shorter + longer):
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= threshold and m.ratio() >= threshold


@F.pandas_udf(T.DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; depends on the argument order."""
    return pd.Series(
        [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64",
    )


@F.pandas_udf(T.BooleanType())
def _fuzzy_same(joined_a: pd.Series, joined_b: pd.Series, flat_a: pd.Series, flat_b: pd.Series,
                core_a: pd.Series, core_b: pd.Series) -> pd.Series:
    def verdict(ja, jb, fa, fb, ca, cb):
        if ja is None:
            return False
        if _at_least(ja, jb, JOINED_RATIO):
            return True
        if fa and fb and _at_least(fa, fb, JOINED_RATIO):
            return True
        near = sum(any(_at_least(t, u, TOKEN_RATIO) for u in cb) for t in ca)
        return near / min(len(ca), len(cb)) >= TOKEN_SHARE

    return pd.Series(
        [verdict(*row) for row in zip(joined_a, joined_b, flat_a, flat_b, core_a, core_b)], dtype="bool"
    )


def _joined(core: Column) -> Column:
    return F.array_join(F.sort_array(core), "")


def _flat(norm: Column) -> Column:
    return F.regexp_replace(norm, "[^A-Z0-9]", "")


def exact_identity(a: Column, b: Column, core_a: Column, core_b: Column) -> Column:
    """True where a cheap test already says "same", false where undecided."""
    return F.coalesce(
        (a == b)
        | (F.size(core_a) == 0)
        | (F.size(core_b) == 0)
        | is_placeholder(b)
        | (F.size(F.array_except(core_a, core_b)) == 0)
        | (F.size(F.array_except(core_b, core_a)) == 0)
        | (_joined(core_a) == _joined(core_b))
        | ((_flat(a) != "") & (_flat(a) == _flat(b))),
        F.lit(False),
    )


def with_same_business(
    df: DataFrame, a: str, b: str, out: str = "same", vocabulary: Sequence[str] | None = None,
    needed: Column | None = None, fuzzy: bool = True,
) -> DataFrame:
    """Add the identity verdict of labels ``a`` (before) and ``b`` (after).

    Judged once per distinct pair of labels, then joined back.
    ``needed`` restricts the work to rows whose verdict matters; others get
    null.  With ``fuzzy=False`` undecided pairs count as different.
    """
    needed = F.lit(True) if needed is None else needed
    marked = df.withColumn("_need", needed & F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = marked.where("_need").select(a, b).distinct()
    # the two cores are used by several tests: computed once, as columns
    pairs = pairs.withColumn("_ca", core_tokens(a, vocabulary)).withColumn("_cb", core_tokens(b, vocabulary))
    ca, cb = F.col("_ca"), F.col("_cb")
    pairs = pairs.withColumn("_sure", exact_identity(F.col(a), F.col(b), ca, cb))
    if fuzzy:
        undecided = ~F.col("_sure")
        likely = _fuzzy_same(
            F.when(undecided, _joined(ca)), F.when(undecided, _joined(cb)),
            F.when(undecided, _flat(F.col(a))), F.when(undecided, _flat(F.col(b))),
            F.when(undecided, ca), F.when(undecided, cb),
        )
        pairs = pairs.withColumn("_likely", likely).withColumn("_sure", F.col("_sure") | F.col("_likely"))
    judged = pairs.select(a, b, F.col("_sure").alias("_same"))
    joined = marked.join(judged, [a, b], "left")
    return joined.withColumn(out, F.when(F.col("_need"), F.col("_same"))).drop("_need", "_same")


def with_first_version_similarity(df: DataFrame, a: str, b: str, out: str = "similar",
                                  threshold: float = FIRST_VERSION_RATIO) -> DataFrame:
    """Earlier rule: whole-label ratio; empty labels are never similar."""
    pairs = df.where((F.col(a) != "") & (F.col(b) != "")).select(a, b).distinct()
    judged = pairs.withColumn(out, ratcliff_ratio(a, b) >= threshold)
    return df.join(judged, [a, b], "left").withColumn(out, F.coalesce(out, F.lit(False)))
