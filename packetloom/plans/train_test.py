"""Feature rows to balanced train and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import lengths, sampling
from packetloom.sources.tables import FEATURE_SCHEMA, write_parquet, write_parts

# Fixed value: where feature files lie below a source directory.
FEATURE_GLOB = "*.transformed.parquet/*.parquet"


def prepare(
    df: DataFrame,
    ids: list[str],
    min_feature_len: int | None = None,
    sample_per_label: int | None = None,
    test_ratio: float | None = None,
    label: str = "labels",
    length: str = "feature_len",
    threshold: int = lengths.ENOUGH,
    short: int = lengths.SHORT,
    seed: int = sampling.SAMPLE_SEED,
) -> DataFrame:
    """Filter by length, cap every label, split; each step is skipped if its argument is null or 0.

    Cap and split are two thresholds on one order, so both cost one pass over labels and ids.
    """
    df = lengths.labelled_rows(df, label, length)
    if min_feature_len:
        df = lengths.filter_two_tier(df, min_feature_len, threshold, short, label, length)
    if sample_per_label and test_ratio:
        return sampling.sample_and_split(df, ids, sample_per_label, test_ratio, label, seed)
    if sample_per_label:
        return sampling.under_sample(df, ids, sample_per_label, label, seed)
    if test_ratio:
        return sampling.split_exact(df, ids, test_ratio, label, seed)
    return df


def run(
    spark: SparkSession,
    source: str,
    target: str,
    min_feature_len: int | None = None,
    sample_per_label: int | None = None,
    test_ratio: float | None = None,
    id_schema: str | None = None,
) -> DataFrame:
    """From feature files to ``target``; returns the labels that the length filter lost.

    ``id_schema`` declares id columns that the files carry besides the feature columns. Without
    them a row's content is its id, which means reading it for every cut.
    """
    df = spark.read.schema(", ".join(filter(None, [FEATURE_SCHEMA, id_schema]))).parquet(f"{source}/{FEATURE_GLOB}")
    ids = [c for c in df.columns if c not in ("x", "feature_len", "labels")]
    if not ids:
        df, ids = df.withColumn("row_id", F.sha2("x", 256)), ["row_id"]
    made = prepare(df, ids, min_feature_len, sample_per_label, test_ratio).drop("row_id")
    if test_ratio:
        write_parts(made, target)
    else:
        write_parquet(made, target)
    original = lengths.labelled_rows(df)
    kept = lengths.filter_two_tier(original, min_feature_len) if min_feature_len else original
    return lengths.lost_labels(original, kept)


def few_shot(
    df: DataFrame, ids: list[str], target: str, ratios: list[float], n: int = 2000, label: str = "labels"
) -> None:
    """Write the train/test splits of all ratios, partitioned by ratio and part."""
    write_parquet(sampling.split_ratios(df, ids, n, ratios, label), target, by=["ratio", "part"])
