"""File listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.names import clean_stem, directory_label, file_stem, folded_order, relative_directory
from packetloom.operators.ranking import numbered
from packetloom.operators.stored import attach, stored


def group_files(listing: DataFrame, root: str, threshold: int = 0) -> DataFrame:
    """``split, dataset, path, length, duplicate`` of files longer than ``threshold``.

    The split is the directory below ``root`` ("." for the root itself), the dataset the cleaned
    file stem. Stems that coincide after cleaning are all kept and flagged.
    """
    named = listing.where(F.col("length") > threshold).select(
        relative_directory(F.col("path"), root.rstrip("/")).alias("split"),
        clean_stem(file_stem(F.col("path"))).alias("dataset"),
        "path",
        "length",
    )
    names = ["split", "dataset"]
    same = named.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return attach(named, stored(same, "same-names"), names, "left").select(
        *named.columns, F.col("_n").isNotNull().alias("duplicate")
    )


def list_files(spark: SparkSession, root: str, pattern: str, threshold: int = 0) -> DataFrame:
    """Group the files below ``root`` that match the pattern; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    )
    return group_files(files, root, threshold)


def labelled_files(listing: DataFrame) -> DataFrame:
    """Add the label a file's directory stands for: ``path, length, label``."""
    return listing.withColumn("label", directory_label(F.col("path")))


def directory_ids(listing: DataFrame) -> DataFrame:
    """``label, label_id``: directories numbered from 0 in case-insensitive order, names as they are."""
    names = listing.select(directory_label(F.col("path")).alias("label")).distinct()
    numbers = numbered(stored(names, "labels"), folded_order("label"), "label_id", start=0)
    return numbers.select("label", F.col("label_id").cast("int"))

