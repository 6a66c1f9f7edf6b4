"""Consecutive-snapshot pairs, churn labels and their reports.

All cohorts are built in one plan: the panel joins itself on
``(id, anio + 1)``, so a year without a following snapshot simply has no pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.similarity import with_first_version_similarity, with_same_business
from panelflow.functions.text import core_tokens, is_placeholder
from panelflow.operators.ordered import with_row

KEEP_AFTER = ("norm", "open")


def snapshot_pairs(panel: DataFrame, id_col: str = "id", year: str = "anio",
                   after: Sequence[str] = KEEP_AFTER) -> DataFrame:
    """Left join of every snapshot with the next one.

    Only years that do have a following snapshot form cohorts; columns of the
    later year get the suffix ``1``; ``present`` tells if the id survived.
    """
    later = panel.select(
        F.col(id_col), (F.col(year) - 1).cast("int").alias(year),
        *[F.col(c).alias(f"{c}1") for c in after], F.lit(True).alias("present"),
    )
    years = panel.select((F.col(year) - 1).cast("int").alias(year)).distinct()
    pairs = panel.join(F.broadcast(years), year, "left_semi").join(later, [id_col, year], "left")
    pairs = pairs.withColumn("present", F.coalesce("present", F.lit(False)))
    if "norm" in after:
        pairs = pairs.withColumn("norm1", F.coalesce("norm1", F.lit("")))
    if "open" in after:
        pairs = pairs.withColumn("open1", F.coalesce("open1", F.lit(False)))
    return pairs.withColumnRenamed(year, "cohort")


def informative(norm: Column | str, vocabulary: Sequence[str] | None = None) -> Column:
    """Neither placeholder nor generic."""
    n = F.col(norm) if isinstance(norm, str) else norm
    return ~is_placeholder(n) & (F.size(core_tokens(n, vocabulary)) > 0)


def label_pairs(panel: DataFrame, vocabulary: Sequence[str] | None = None, fuzzy: bool = True,
                require_open_after: bool = True, after: Sequence[str] = KEEP_AFTER) -> DataFrame:
    """Universe of a cohort with its turnover label and the parts of it.

    Universe: open with an informative label.  Target: gone, closed, or open
    under a label that is not the same business.
    """
    universe = snapshot_pairs(panel, after=after).where(F.col("open") & informative("norm", vocabulary))
    differs = F.col("present") & (F.col("norm1") != "") & (F.col("norm1") != F.col("norm"))
    if require_open_after:
        differs = differs & F.col("open1")
    universe = universe.withColumn("differs", differs)
    judged = with_same_business(universe, "norm", "norm1", "same", vocabulary, needed=F.col("differs"), fuzzy=fuzzy)
    same = F.coalesce("same", F.lit(False))
    return (
        judged.withColumn("same", same)
        .withColumn("gone", ~F.col("present"))
        .withColumn("closed", F.col("present") & ~F.col("open1"))
        .withColumn("rotated", F.col("differs") & ~F.col("same"))
        .withColumn("target", (F.col("gone") | F.col("closed") | F.col("rotated")).cast("int"))
    )


def churn_decomposition(panel: DataFrame, labelled: DataFrame, vocabulary: Sequence[str] | None = None) -> DataFrame:
    """Per cohort: universe, share excluded, gone, closed, rotated, total."""
    opened = (
        snapshot_pairs(panel, after=()).where("open").groupBy("cohort").agg(
            F.count("*").alias("n_open"),
            F.avg((~informative("norm", vocabulary)).cast("double")).alias("excluded"),
        )
    )
    parts = labelled.groupBy("cohort").agg(
        F.count("*").alias("universe"),
        *[F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in ("gone", "closed", "rotated")],
        F.avg("target").alias("churn"),
    )
    return opened.join(parts, "cohort")


def decomposition_report(panel: DataFrame, labelled: DataFrame, vocabulary: Sequence[str] | None = None) -> DataFrame:
    """Counts of the label with its integrity check (rotated = differ - same)."""
    norm_ph = is_placeholder("norm")
    excluded = snapshot_pairs(panel, after=()).where("open").groupBy("cohort").agg(
        F.count("*").alias("n_open"),
        F.count_if(norm_ph).alias("n_placeholder"),
        F.count_if(~norm_ph & ~informative("norm", vocabulary)).alias("n_generic"),
    )
    counts = labelled.groupBy("cohort").agg(
        F.count("*").alias("universe"),
        F.count_if("gone").alias("n_gone"),
        F.count_if("closed").alias("n_closed"),
        F.count_if("differs").alias("n_differs"),
        F.count_if("same").alias("n_same"),
        F.count_if("rotated").alias("n_rotated"),
        F.sum("target").alias("n_churn"),
    )
    return excluded.join(counts, "cohort").withColumn(
        "consistent", (F.col("n_rotated") == F.col("n_differs") - F.col("n_same")).cast("int")
    ).withColumn("imbalance", (1 - F.col("n_churn") / F.col("universe"))
                 / F.greatest(F.col("n_churn") / F.col("universe"), F.lit(1e-9)))


def first_version_report(panel: DataFrame) -> DataFrame:
    """Literal label comparison and its false-positive estimate."""
    u = snapshot_pairs(panel).where(F.col("open") & (F.trim("label") != ""))
    u = u.withColumn("gone", ~F.col("present")).withColumn("closed", F.col("present") & ~F.col("open1"))
    u = u.withColumn("changed", F.col("present") & (F.col("norm1") != "") & (F.col("norm") != F.col("norm1")))
    u = u.withColumn("churn", F.col("gone") | F.col("closed") | F.col("changed"))
    u = u.withColumn("_b", F.when(F.col("changed"), F.col("norm1")).otherwise(""))
    s = with_first_version_similarity(u, "norm", "_b", "similar")
    return s.groupBy("cohort").agg(
        F.count("*").alias("universe"),
        F.count_if("gone").alias("n_gone"),
        F.count_if("closed").alias("n_closed"),
        F.count_if("changed").alias("n_changed"),
        F.count_if("churn").alias("n_churn"),
        F.count_if(F.col("changed") & F.col("similar")).alias("n_similar"),
    ).withColumn("corrected_churn", (F.col("n_churn") - F.col("n_similar")) / F.col("universe"))


def common_label_share(panel: DataFrame) -> DataFrame:
    """Ids in both years of each pair and the share with an identical label."""
    p = snapshot_pairs(panel, after=("norm",)).where("present")
    return p.groupBy("cohort").agg(
        F.count("*").alias("n_common"), F.avg((F.col("norm") == F.col("norm1")).cast("double")).alias("identical")
    )


def suspicious_pairs(similarity: DataFrame, margin: float = 0.01) -> DataFrame:
    """Year pairs whose similarity exceeds the median by ``margin``.

    One row per pair of years, so the built-in percentile is bounded.
    """
    median = similarity.agg(F.percentile("identical", 0.5)).scalar()
    return similarity.withColumn("median", median).where(F.col("identical") > F.col("median") + margin)


def distinct_label_report(raw: DataFrame, id_col: str, year: str, norm: str) -> DataFrame:
    """Ids with more than one label in a year."""
    per_id = raw.groupBy(year, id_col).agg(F.count_distinct(norm).alias("k"))
    return per_id.groupBy(year).agg(
        F.count("*").alias("n_ids"),
        F.count_if(F.col("k") > 1).alias("n_multi"),
        F.avg((F.col("k") > 1).cast("double")).alias("share_multi"),
        F.max("k").alias("max_labels"),
    )


def single_label_ids(raw: DataFrame, id_col: str, year: str, norm: str, years: tuple[int, int]) -> DataFrame:
    """Ids that carry exactly one label in both years."""
    one = (
        raw.where(F.col(year).isin(*years)).groupBy(year, id_col)
        .agg((F.min(norm) == F.max(norm)).alias("single")).where("single")
    )
    return one.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n = 2").select(id_col)


def multi_label_impact(panel: DataFrame, raw: DataFrame, id_col: str, year: str, norm: str,
                       years: tuple[int, int]) -> DataFrame:
    """Literal churn of all open premises and of the single-label ones."""
    clean_ids = single_label_ids(raw, id_col, year, norm, years).withColumn("single", F.lit(True))
    u = snapshot_pairs(panel.where(F.col(year).isin(*years)))
    u = u.where((F.col("cohort") == years[0]) & F.col("open") & (F.col("norm") != ""))
    churn = ~F.col("present") | ~F.col("open1") | (F.col("norm1") != F.col("norm"))
    u = u.withColumn("churn", churn.cast("double")).join(clean_ids, id_col, "left")
    return u.agg(
        F.count("*").alias("n_all"),
        F.avg("churn").alias("churn_all"),
        F.count("single").alias("n_single"),
        F.avg(F.when(F.col("single"), F.col("churn"))).alias("churn_single"),
    )


def business_key_report(panel: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Earlier churn definition: the same premises under the same key a year on.

    An open row survives when its (id, key) is open next year, is replaced
    when the id is there under another key, and has vanished otherwise.
    """
    now = panel.where("open").select("id", "anio", F.concat_ws("|", *key_cols).alias("key"))
    nxt = now.select("id", (F.col("anio") - 1).cast("int").alias("anio"), "key", F.lit(True).alias("alive"))
    any_row = panel.select("id", (F.col("anio") - 1).cast("int").alias("anio"), F.lit(True).alias("there")).distinct()
    years = panel.select((F.col("anio") - 1).cast("int").alias("anio")).distinct()
    j = (
        now.join(F.broadcast(years), "anio", "left_semi").join(nxt.distinct(), ["id", "anio", "key"], "left")
        .join(any_row, ["id", "anio"], "left")
    )
    outcome = F.when(F.col("alive"), "survives").when(F.col("there"), "replaced").otherwise("vanished")
    return j.groupBy(F.col("anio").alias("cohort"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def status_only_report(panel: DataFrame) -> DataFrame:
    """Status-only churn definition: open now, not open (or absent) next year."""
    u = snapshot_pairs(panel, after=("open",)).where("open")
    return u.groupBy("cohort").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("open1")).alias("n_lost"),
        F.avg((~F.col("open1")).cast("double")).alias("churn"),
    )


def persistence(panel: DataFrame) -> DataFrame:
    """Ids present in both years of each consecutive pair."""
    ids = panel.select("anio", "id").distinct()
    both = ids.intersect(ids.select((F.col("anio") - 1).cast("int").alias("anio"), "id"))
    return both.groupBy("anio").agg(F.count("*").alias("n_common"))


def literal_audit(labelled: DataFrame, literal: str) -> DataFrame:
    """How often a given label is the origin or destination of the target."""
    is_from, is_to = F.col("norm") == literal, F.col("norm1") == literal
    hit = F.col("target") == 1
    return labelled.groupBy("cohort").agg(
        F.count_if(is_from).alias("n_from"),
        F.count_if(is_to & F.col("present")).alias("n_to"),
        F.count_if(hit & (is_from | is_to)).alias("n_in_target"),
        F.try_divide(F.count_if(hit & (is_from | is_to)), F.count_if(hit)).alias("share_of_target"),
    )


def exclusion_bias(panel: DataFrame, section: str, vocabulary: Sequence[str] | None = None, n: int = 3) -> DataFrame:
    """Sections most over-represented among premises excluded as generic."""
    excluded = ~is_placeholder("norm") & (F.size(core_tokens("norm", vocabulary)) == 0)
    g = panel.where("open").groupBy(section).agg(F.count("*").alias("_all"), F.count_if(excluded).alias("_ex"))
    # one row per section: totals over the small grouped table
    tot = g.agg(F.sum("_all").alias("a"), F.sum("_ex").alias("e"))
    g = with_row(g.where(F.col("_ex") > 0), tot)
    g = g.select(section, (F.col("_ex") / F.col("e") - F.col("_all") / F.col("a")).alias("difference"))
    return g.orderBy(F.desc("difference"), section).limit(n)


def prefix_counts(panel: DataFrame, prefix: str = "SIN ") -> DataFrame:
    """Labels that start like a placeholder but are not one, over all years."""
    return panel.where(F.col("norm").startswith(prefix) & ~is_placeholder("norm")).groupBy("norm").agg(
        F.count("*").alias("n")
    )


def text_signatures(labelled: DataFrame, label: str, label1: str) -> DataFrame:
    """Upper bound of label error: rotations that show a text artefact."""
    from panelflow.functions.text import DIGIT_IN_WORD, MOJIBAKE

    def sig(c, pattern, up=False):
        v = F.coalesce(F.col(c), F.lit(""))
        return (F.upper(v) if up else v).rlike(pattern)

    moji = sig(label, MOJIBAKE) | sig(label1, MOJIBAKE)
    digit = sig(label, DIGIT_IN_WORD, True) | sig(label1, DIGIT_IN_WORD, True)
    return labelled.where("rotated").groupBy("cohort").agg(
        F.count("*").alias("n_rotated"),
        F.count_if(moji).alias("n_mojibake"),
        F.count_if(digit).alias("n_digit"),
        F.count_if(moji | digit).alias("n_any"),
    )
