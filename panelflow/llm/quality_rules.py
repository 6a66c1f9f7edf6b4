"""Quality rules: robust multivariate outliers of text statistics.

Per document, statistics of the whole text; per language and source, a
minimum-covariance-determinant estimate of their transformed vector; a document
whose squared Mahalanobis distance exceeds the cut is rejected.  Everything is
a DataFrame expression.

Base rules reject a text of fewer than ``MIN_WORDS`` words, or with more than
half of its words in repeated three-word windows.

The estimate.  Three starts (medians with their absolute deviations, with the
correlations of squashed deviations, and with those of deviations of unit
length) go through concentration steps side by side: distances under the last
estimate, then mean and covariance of the ``SUPPORT`` share of the group's rows
with the smallest ones, with the consistency factor of that share.  A step is
one aggregate: rows are summed by group and bin of their distance, and the bins
are taken up to the share, the last one in part.  Steps go on until no group's
determinant falls any more; each group takes its start with the smallest one.
``NOISE`` is added to the variances (a share of counted characters or words has
about that variance by counting alone), so a statistic that is constant in a
group gives finite distances, and so does a ``PRIOR`` that weighs as much as
``LEAST`` rows.

Groups with fewer than ``LEAST`` rows take the estimate of their language, and
languages with fewer that of all rows, whatever their number.

Defined results: null and empty texts have all statistics zero and fail the
base rules.  Null language or source is a group of its own.  Repeated rows are
judged alike and all come back.  Further columns are kept; an empty table stays
empty.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.store import Store

MIN_WORDS = 50
REPEAT_PERCENT = 50
SUPPORT = 0.75
#: Steps at most, and the fall of a log determinant that counts.
STEPS, SETTLED = 30, 0.01
LEAST = 60
#: Share of rows of a normal group that the cut lets through; texts have heavier tails.
LEVEL = 1 - 1e-8
#: Variances of counting, and of a group without rows, in the units of ``vector`` below.
NOISE = [1e-3, 1e-4, 2e-4, 1e-3, 1e-3, 2e-4, 2e-4]
PRIOR = [0.25, 0.01, 0.001, 0.0025, 0.01, 0.001, 0.001]
#: Bins of distances for each doubling.
BINS = 4
#: Tables of one row per group are broadcast up to this number of rows (some 500 bytes each).
SMALL_GROUPS = 50_000
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text."""

    def covered(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(
                F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.cast("int").alias("i")),
        )

        def among(s: Column) -> Column:
            n = F.size(s)
            twins = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
            starts = F.flatten(F.filter(twins, lambda t: t.isNotNull()))
            spread = F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))
            return F.size(F.array_distinct(spread))

        return _let(F.array_sort(windows), among)

    return F.when(F.size(words) >= 4, _let(words, covered)).otherwise(0)


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text: words, their characters, symbols, repeats, capitals, marks."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, WHITE, "")
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    letters = F.regexp_replace(bare, r"[^\p{L}]+", "")
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.char_length(letters).cast("long").alias("n_letters"),
        F.char_length(F.regexp_replace(letters, r"\p{Lu}+", "")).cast("long").alias("n_small"),
    )


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{s}.n_words"))


def vector(s: str) -> list[Column]:
    """Transformed statistics: logarithm of the length, and square roots of shares."""
    words = F.greatest(F.col(f"{s}.n_words"), F.lit(1))
    chars = F.greatest(F.col(f"{s}.word_chars"), F.lit(1))
    marks = F.col(f"{s}.word_chars") - F.col(f"{s}.n_letters") - F.col(f"{s}.n_symbols")
    return [
        F.log1p(F.col(f"{s}.n_words")),
        F.log(chars / words),
        F.sqrt(F.col(f"{s}.n_symbols") / chars),
        F.sqrt(F.col(f"{s}.n_dup_lines") / words),
        F.sqrt(F.col(f"{s}.n_repeat_words") / words),
        F.sqrt((F.col(f"{s}.n_letters") - F.col(f"{s}.n_small")) / chars),
        F.sqrt(F.greatest(marks, F.lit(0)) / chars),
    ]


D = len(NOISE)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
PARTS = [f"m{i}" for i in range(D)] + [f"l{i}_{j}" for i, j in PAIRS]
KEY = ["k_lang", "k_source"]
ANY = "\x01"


def chi_square(x: float, k: int) -> float:
    """Distribution function of the sum of ``k`` squared normal variables."""
    term = total = 1.0 / math.gamma(k / 2 + 1)
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= (x / 2) / (k / 2 + n)
        total += term
    return total * (x / 2) ** (k / 2) * math.exp(-x / 2)


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return low


#: Covariance of a normal group over that of its most central ``SUPPORT`` share.
CONSISTENCY = SUPPORT / chi_square(chi_square_quantile(SUPPORT, D), D + 2)
#: Squared distances above this are outliers.
CUT = chi_square_quantile(LEVEL, D)


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, marked for broadcasting if their number is within the bound."""
    return F.broadcast(rows) if rows.count() <= SMALL_GROUPS else rows


def _factor(df: DataFrame, rows: str) -> DataFrame:
    """Lower Cholesky factor ``l*`` and ``logdet`` of the covariances ``c*`` of ``rows`` rows, made regular."""
    share = F.lit(LEAST) / (LEAST + F.col(rows))
    df = df.withColumns({f"c{i}_{i}": F.greatest(F.col(f"c{i}_{i}"), F.lit(0.0)) + NOISE[i] + share * PRIOR[i] for i in range(D)})
    for i, j in PAIRS:
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(NOISE[i] / 4))) if i == j else rest / F.col(f"l{j}_{j}"))
    return df.withColumn("logdet", 2 * sum((F.log(f"l{i}_{i}") for i in range(1, D)), F.log("l0_0")))


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``d2`` from x*, m* and l*, by forward substitution."""
    for i in range(D):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, D)), F.col("z0") * F.col("z0")))


def _starts(points: DataFrame, store: Store) -> DataFrame:
    """Three starts per group: center ``m*`` (also kept as ``o*``) and factor ``l*``."""
    middle = store.keep(points.groupBy(*KEY).agg(F.count("*").alias("rows"), *[F.percentile_approx(f"x{i}", 0.5, 500).alias(f"o{i}") for i in range(D)]), "middle")
    off = points.join(_small(middle), KEY).select(*KEY, "rows", *[(F.col(f"x{i}") - F.col(f"o{i}")).alias(f"x{i}") for i in range(D)])
    wide = store.keep(off.groupBy(*KEY).agg(*[F.percentile_approx(F.abs(f"x{i}"), 0.5, 500).alias(f"s{i}") for i in range(D)]), "wide")
    wide = wide.select(*KEY, *[F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + NOISE[i]).alias(f"s{i}") for i in range(D)])
    unit = off.join(_small(wide), KEY).select(*KEY, *[(F.col(f"x{i}") / F.col(f"s{i}")).alias(f"x{i}") for i in range(D)])
    length = F.sqrt(sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(1, D)), F.col("x0") * F.col("x0")))
    unit = unit.select(*KEY, *[F.tanh(f"x{i}").alias(f"a{i}") for i in range(D)], *[(F.col(f"x{i}") / F.greatest(length, F.lit(1e-9))).alias(f"b{i}") for i in range(D)])
    sums = unit.groupBy(*KEY).agg(*[F.avg(F.col(f"{v}{i}") * F.col(f"{v}{j}")).alias(f"{v}{i}_{j}") for v in "ab" for i, j in PAIRS])
    told = middle.join(sums, KEY).join(wide, KEY)

    def start(k: int, v: str | None) -> Column:
        def covariance(i: int, j: int) -> Column:
            scale = F.col(f"s{i}") * F.col(f"s{j}")
            if v is None or i == j:
                return scale if i == j else F.lit(0.0)
            # correlations are drawn in a little, so that they are those of some distribution
            return 0.95 * scale * F.col(f"{v}{i}_{j}") / F.sqrt(F.greatest(F.col(f"{v}{i}_{i}") * F.col(f"{v}{j}_{j}"), F.lit(1e-12)))

        return F.struct(F.lit(k).alias("start"), *[covariance(i, j).alias(f"c{i}_{j}") for i, j in PAIRS])

    out = told.select(*KEY, "rows", *[f"o{i}" for i in range(D)], F.explode(F.array(start(0, None), start(1, "a"), start(2, "b"))).alias("t"))
    out = out.select(*KEY, "rows", "t.*", *[f"o{i}" for i in range(D)], *[F.col(f"o{i}").alias(f"m{i}") for i in range(D)])
    return _factor(out, "rows").select(*KEY, "start", "rows", "logdet", *[f"o{i}" for i in range(D)], *PARTS)


def _concentrate(points: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of all groups and starts; ``before`` is the last log determinant."""
    kept = [*KEY, "start", "rows", "logdet", *[f"o{i}" for i in range(D)]]
    far = _distance(points.join(_small(model), KEY))
    place = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS).cast("int")
    off = [F.col(f"x{i}") - F.col(f"o{i}") for i in range(D)]
    bins = far.groupBy(*kept, place.alias("bin")).agg(
        F.count("*").alias("n"), *[F.sum(off[i]).alias(f"s{i}") for i in range(D)], *[F.sum(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in PAIRS])
    earlier = Window.partitionBy(*KEY, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # some hundred bins
    left = SUPPORT * F.col("rows") - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    bins = bins.withColumn("w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("n"))))
    sums = bins.groupBy(*kept).agg(
        F.sum(F.col("w") * F.col("n")).alias("n"), *[F.sum(F.col("w") * F.col(f"s{i}")).alias(f"s{i}") for i in range(D)],
        *[F.sum(F.col("w") * F.col(f"p{i}_{j}")).alias(f"p{i}_{j}") for i, j in PAIRS])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(D)]
    out = sums.select(
        *KEY, "start", "rows", F.col("logdet").alias("before"), *[f"o{i}" for i in range(D)], *[(F.col(f"o{i}") + mean[i]).alias(f"m{i}") for i in range(D)],
        *[(CONSISTENCY * (F.col(f"p{i}_{j}") / F.col("n") - mean[i] * mean[j])).alias(f"c{i}_{j}") for i, j in PAIRS])
    return _factor(out, "rows").select(*KEY, "start", "rows", "logdet", "before", *[f"o{i}" for i in range(D)], *PARTS)


def estimates(points: DataFrame, store: Store) -> DataFrame:
    """Minimum covariance determinant (m*, l*) of every group ``KEY`` of ``points``."""
    model = store.keep(_starts(points, store), "start")
    for step in range(STEPS):
        after = store.keep(_concentrate(points, model.drop("before")), "model")
        store.drop(model)
        model = after
        # starts have no support of their own, so their determinants are not compared
        fall = model.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        if fall is None or (step and fall < SETTLED):
            break
    best = model.groupBy(*KEY).agg(F.min_by(F.struct("rows", *PARTS), F.struct("logdet", "start")).alias("b"))
    return best.select(*KEY, "b.*")


def _keyed(points: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(rows under the group they estimate, the group that each language and source is judged by)."""
    sizes = points.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = store.keep(sizes.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang"))), "sizes")
    k_lang = F.when((F.col("n") >= LEAST) | (F.col("n_lang") >= LEAST), F.col("lang")).otherwise(ANY)
    k_source = F.when(F.col("n") >= LEAST, F.col("source")).otherwise(ANY)
    used = store.keep(sizes.select("lang", "source", k_lang.alias("k_lang"), k_source.alias("k_source")), "groups")
    x = [f"x{i}" for i in range(D)]
    own = points.join(_small(used.where(F.col("k_source") != ANY).select("lang", "source")), ["lang", "source"], "left_semi")
    parts = [own.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), *x)]
    langs = used.where((F.col("k_source") == ANY) & (F.col("k_lang") != ANY)).select("lang").distinct()
    if not langs.isEmpty():
        some = points.join(_small(langs), "lang", "left_semi")
        parts.append(some.select(F.col("lang").alias("k_lang"), F.lit(ANY).alias("k_source"), *x))
    if not used.where(F.col("k_lang") == ANY).isEmpty():
        parts.append(points.select(F.lit(ANY).alias("k_lang"), F.lit(ANY).alias("k_source"), *x))
    return store.keep(reduce(DataFrame.unionByName, parts), "keyed"), used


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          carry: list[str] | None = None) -> DataFrame:
    """(row, s, base_failed, distance, kept) per document.

    ``row`` is a struct of the columns ``carry`` (all by default), ``s`` the
    statistics; ``distance`` is null in groups of which no row passes the base
    rules.
    """
    store = Store(docs.sparkSession, "quality")
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    judged = store.keep(docs.select(
        carried.alias("row"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("\x00")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")).alias("source"),
        statistics(F.col(text_col).cast("string")).alias("s"),
    ), "statistics")
    located = judged.withColumns({f"x{i}": x.cast("double") for i, x in enumerate(vector("s"))})
    points, used = _keyed(located.where(~base_failed("s")).select("lang", "source", *[f"x{i}" for i in range(D)]), store)
    models = estimates(points, store)
    models = store.keep(used.join(models, KEY).select("lang", "source", *PARTS), "models")
    store.drop(points)
    far = _distance(located.join(_small(models), ["lang", "source"], "left"))
    return far.select(
        "row", "s", base_failed("s").alias("base_failed"), F.col("d2").alias("distance"),
        (~base_failed("s") & ~F.coalesce(F.col("d2") > CUT, F.lit(False))).alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    return judge(docs).where("kept").select("row.*")
