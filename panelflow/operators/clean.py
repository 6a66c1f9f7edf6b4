"""Row-level cleaning of register snapshots, with the counts that audit it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.numbers import clip, decimal_comma
from panelflow.functions.text import (
    DIGIT_IN_WORD, MOJIBAKE, is_placeholder, match_key, match_key_no_zeros, normalise,
)
from panelflow.operators.ordered import with_row

MIN_COORDINATE = 1000.0  # fixed value: smaller coordinates mean "no data"
UNMATCHED_LIMIT = 0.20  # fixed value: share of unknown categories that stops scoring


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (add a unique column last).

    An aggregate, not a window: rows of a heavily repeated key are reduced
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def valid_point(x: Column | str, y: Column | str) -> Column:
    cx = F.col(x) if isinstance(x, str) else x
    cy = F.col(y) if isinstance(y, str) else y
    return F.coalesce((cx > MIN_COORDINATE) & (cy > MIN_COORDINATE), F.lit(False))


def coordinate_class(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """null / zero / outside / valid; ``box`` is (x_min, x_max, y_min, y_max)."""
    return (
        F.when(x.isNull() | y.isNull(), "null")
        .when((x == 0) | (y == 0), "zero")
        .when(~(x.between(box[0], box[1]) & y.between(box[2], box[3])), "outside")
        .otherwise("valid")
    )


def coordinate_quality(df: DataFrame, x: str, y: str, fallback_x: str, box) -> DataFrame:
    """Rows per coordinate class, and how many the group coordinate rescues."""
    marked = df.select(
        coordinate_class(decimal_comma(x), decimal_comma(y), box).alias("quality"),
        (decimal_comma(fallback_x) > 0).alias("_backup"),
    )
    return marked.groupBy("quality").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_backup") & (F.col("quality") != "valid")).alias("n_rescued"),
    )


def open_flag(status: Column | str) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.upper(c).contains("ABIERT"), F.lit(False))


def is_interior(access: Column | str) -> Column:
    c = F.col(access) if isinstance(access, str) else access
    return F.coalesce(match_key(c) == "INTERIOR", F.lit(False))


def exclude_interior(df: DataFrame, access: str) -> DataFrame:
    """Drop interior premises; a null access stays."""
    return df.where(~is_interior(access))


def interior_report(df: DataFrame, access: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(is_interior(access)).alias("n_interior"),
        F.avg(is_interior(access).cast("double")).alias("share_interior"),
    )


def trim_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns})


def resolve_column(columns: Sequence[str], candidates: Sequence[str], substring: bool = False) -> str | None:
    """First column that equals (or contains) a candidate, ignoring case."""
    lowered = {c.lower(): c for c in columns}
    for want in (w.lower() for w in candidates):
        if want in lowered:
            return lowered[want]
        if substring:
            for low, original in lowered.items():
                if want in low:
                    return original
    return None


def status_group(status: Column | str) -> Column:
    s = F.lower(F.col(status) if isinstance(status, str) else status)
    return (
        F.when(s.contains("abiert"), "open")
        .when(s.contains("cerrad"), "closed")
        .when(s.contains("vivienda") | s.contains("obra"), "housing or works")
        .otherwise("dropped or other")
    )


def status_shares(df: DataFrame, status: str, by: str) -> DataFrame:
    counts = df.groupBy(by, status_group(status).alias("state")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_total"))
    return counts.join(totals, by).select(by, "state", "n", (F.col("n") / F.col("_total")).alias("share"))


def training_ranges(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: min and max of every numeric feature."""
    return train.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])


def clip_to_ranges(df: DataFrame, ranges: DataFrame | Mapping[str, tuple], columns: Sequence[str]) -> DataFrame:
    """Clip features to the training range and list a warning per clipped one.

    ``ranges``: the row of ``training_ranges``, or (low, high) per column as
    numbers, which streams can use; a range of nulls clips nothing.
    """
    if isinstance(ranges, Mapping):
        ends = {c: tuple(F.lit(v).cast("double") for v in ranges[c]) for c in columns}
        joined = df
    else:
        joined = with_row(df, ranges)
        ends = {c: (F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in columns}
    out = [F.when((F.col(c) < ends[c][0]) | (F.col(c) > ends[c][1]), F.lit(c)) for c in columns]
    joined = joined.withColumn("warnings", F.array_compact(F.array(*out)))
    joined = joined.withColumns({c: clip(c, *ends[c]) for c in columns})
    return joined.select(*df.columns, "warnings")


def clip_report(df: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: range and number of values below and above it."""
    counts = with_row(df, ranges).agg(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.min(f"{c}_lo").alias("lo"),
                F.min(f"{c}_hi").alias("hi"),
                F.count_if(F.col(c) < F.col(f"{c}_lo")).alias("n_low"),
                F.count_if(F.col(c) > F.col(f"{c}_hi")).alias("n_high"),
            ).alias(c)
            for c in columns
        ]
    )
    return counts.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def fill_defaults(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Missing counts are zero; ratios stay null."""
    return df.fillna(dict.fromkeys(counts, 0))


def missing_columns(columns: Sequence[str], needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in columns]


def require_columns(columns: Sequence[str], needed: Sequence[str]) -> None:
    if missing := missing_columns(columns, needed):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def canonical_values(train: DataFrame, column: str) -> DataFrame:
    """(value) seen in training with both match keys; a key two values share
    goes to the smallest value."""
    seen = train.where(F.col(column).isNotNull()).select(F.col(column).alias("canonical")).distinct()
    return seen.withColumn("key1", match_key("canonical")).withColumn("key2", match_key_no_zeros("canonical"))


def remap_categories(df: DataFrame, canonical: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Rewrite a category in its training form.

    Exact key first, then the key without leading zeros; unknown values stay
    and are flagged in ``<out>_unmatched``.
    """
    out = out or column
    by1 = canonical.groupBy(F.col("key1").alias("_k1")).agg(F.min("canonical").alias("_m1"))
    by2 = canonical.groupBy(F.col("key2").alias("_k2")).agg(F.min("canonical").alias("_m2"))
    j = (
        df.withColumn("_k1", match_key(column)).withColumn("_k2", match_key_no_zeros(column))
        .join(by1, "_k1", "left").join(by2, "_k2", "left")
    )
    unmatched = F.col(column).isNotNull() & F.col("_m1").isNull() & F.col("_m2").isNull()
    return (
        j.withColumn(f"{out}_unmatched", unmatched)
        .withColumn(out, F.coalesce("_m1", "_m2", F.col(column)))
        .drop("_k1", "_k2", "_m1", "_m2")
    )


def check_unmatched(df: DataFrame, columns: Sequence[str], limit: float = UNMATCHED_LIMIT) -> None:
    """Stop when too many known values of a category have no training form."""
    shares = df.agg(
        *[
            F.try_divide(F.count_if(f"{c}_unmatched"), F.count(c)).alias(c)
            for c in columns
        ]
    ).first()
    bad = {c: shares[c] for c in columns if shares[c] is not None and shares[c] > limit}
    if bad:
        raise ValueError("categories without a training form: " + ", ".join(f"{c} {v:.1%}" for c, v in bad.items()))


def label_quality(df: DataFrame, label: str, by: str) -> DataFrame:
    """Empty, accented, mojibake, digit-in-word and 0-for-O counts per group."""
    raw = F.coalesce(F.col(label), F.lit(""))
    norm = normalise(label, digits=False)
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(F.trim(raw) == "").alias("n_empty"),
        F.count_if(raw.rlike("[ÁÉÍÓÚÑáéíóúñ]")).alias("n_accented"),
        F.count_if(raw.rlike(MOJIBAKE)).alias("n_mojibake"),
        F.count_if(F.upper(raw).rlike(DIGIT_IN_WORD)).alias("n_digit_in_word"),
        F.count_if(norm.rlike(r"[A-Z]0[A-Z]|0N\b")).alias("n_ocr"),
    )


def drop_constant(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the features that hold fewer than two values in training.

    min/max instead of counting values: constant time per row and no state.
    """
    ends = train.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if ends[c]["a"] == ends[c]["b"] or ends[c]["a"] is None])


def codes_of_reference_year(df: DataFrame, code: str, year: str, reference: int) -> DataFrame:
    ref = df.where(F.col(year) == reference).select(code).distinct()
    return df.join(ref, code, "left_semi")


def text_filter(df: DataFrame, district: str, district_value: str, activity: str, contains: str) -> DataFrame:
    return df.where(
        (match_key(district) == district_value.strip().upper())
        & match_key(activity).contains(contains.strip().upper())
    )


def clean_panel(raw: DataFrame, key: Sequence[str], order: Sequence[str], label: str = "label",
                status: str = "situation", access: str = "access") -> DataFrame:
    """Raw register rows to one clean row per premises and year."""
    panel = exclude_interior(keep_first(raw, key, order), access)
    return panel.withColumn("norm", normalise(label)).withColumn("open", open_flag(status))


def placeholder_counts(df: DataFrame, norm: str, n: int | None = None) -> DataFrame:
    """Most frequent labels with their placeholder mark."""
    out = df.groupBy(norm).agg(F.count("*").alias("n")).withColumn("placeholder", is_placeholder(norm).cast("int"))
    return out if n is None else out.orderBy(F.desc("n"), norm).limit(n)


def type_columns(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Project an all-text frame to typed columns; bad values become null."""
    return df.select(*[F.trim(c).try_cast(t).alias(c) for c, t in schema.items()])
