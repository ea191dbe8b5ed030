"""Length filters that depend on how many long rows a label has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.stored import attach, stored

# Candidate lengths and thresholds.
LONG = 1024
SHORT = 120
ENOUGH = 200
CANDIDATES = [1024, 700, 600, 500, 400, 140, 50]
ENOUGH_ADAPTIVE = 500


def labelled_rows(df: DataFrame, label: str = "labels", length: str | None = "feature_len") -> DataFrame:
    """Rows with a label and, if a length column is named, some content."""
    keep = F.col(label).isNotNull()
    if length:
        keep = keep & (F.col(length) > 0)
    return df.where(keep)


def long_row_counts(df: DataFrame, lengths: list[int], label: str = "labels", length: str = "feature_len") -> DataFrame:
    """Per label, the rows of at least each length: ``label, n_<length>...``."""
    return df.groupBy(label).agg(*[F.count_if(F.col(length) >= n).alias(f"n_{n}") for n in lengths])


def filter_two_tier(
    df: DataFrame,
    long: int = LONG,
    threshold: int = ENOUGH,
    short: int = SHORT,
    label: str = "labels",
    length: str = "feature_len",
) -> DataFrame:
    """Labels with ``threshold`` rows of at least ``long`` keep those, the others rows of at least ``short``."""
    counts = stored(long_row_counts(df, [long], label, length), "long-rows")
    need = F.when(F.col(f"n_{long}") >= threshold, long).otherwise(short)
    return attach(df, counts, [label]).where(F.col(length) >= need).select(*df.columns)


def chosen_lengths(
    df: DataFrame,
    candidates: list[int] | None = None,
    threshold: int = ENOUGH_ADAPTIVE,
    label: str = "labels",
    length: str = "feature_len",
    literal: bool = False,
) -> DataFrame:
    """Per label the largest candidate that ``threshold`` of its rows reach: ``label, chosen_len``.

    Labels without one are left out. With ``literal`` the count for the first candidate decides
    about all of them, so a label is kept at its largest candidate or not at all.
    """
    candidates = CANDIDATES if candidates is None else candidates
    counts = long_row_counts(df, candidates[:1] if literal else candidates, label, length)
    best = [F.when(F.col(f"n_{candidates[0] if literal else n}") >= threshold, n) for n in candidates]
    chosen = F.greatest(*best) if len(best) > 1 else best[0]
    return counts.select(label, chosen.alias("chosen_len")).where(F.col("chosen_len").isNotNull())


def filter_adaptive(
    df: DataFrame,
    candidates: list[int] | None = None,
    threshold: int = ENOUGH_ADAPTIVE,
    label: str = "labels",
    length: str = "feature_len",
    literal: bool = False,
) -> DataFrame:
    """Keep the rows that reach their label's chosen length."""
    chosen = stored(chosen_lengths(df, candidates, threshold, label, length, literal), "chosen-lengths")
    kept = attach(df, chosen, [label], null_keys=False).where(F.col(length) >= F.col("chosen_len"))
    return kept.select(*df.columns)


def lost_labels(before: DataFrame, after: DataFrame, label: str = "labels") -> DataFrame:
    """Labels that a filter removed altogether, with the rows they had."""
    counts = before.groupBy(label).agg(F.count(F.lit(1)).alias("original_count"))
    return counts.join(after.select(label).distinct(), label, "left_anti")
