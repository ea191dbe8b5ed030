"""Label statistics, numbering and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import clean_label, folded_order
from packetloom.operators.ranking import numbered
from packetloom.operators.stored import attach, stored


def value_counts(df: DataFrame, *columns: str, name: str = "count") -> DataFrame:
    """Rows per combination of values."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def label_distribution(df: DataFrame, label: str = "labels") -> DataFrame:
    """Rows per label in case-insensitive order."""
    return value_counts(df, label).orderBy(*folded_order(label))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return value_counts(df, column, name="frequency").orderBy(F.desc("frequency"), F.asc(column))


def smallest_class(df: DataFrame, label: str, floor: int = 0) -> DataFrame:
    """One row: the size of the smallest class, and the same raised to ``floor``."""
    sizes = value_counts(df, label, name="n")
    return sizes.agg(F.min("n").alias("smallest"), F.greatest(F.min("n"), F.lit(floor)).alias("cap"))


def dense_histogram(df: DataFrame, class_id: str) -> DataFrame:
    """Rows of every class id from 0 to the largest, zeros included: ``class_id, n``."""
    counts = stored(value_counts(df.where(F.col(class_id).isNotNull()), class_id, name="n"), "class-counts")
    top = counts.agg(F.max(class_id)).first()[0]
    ids = df.sparkSession.range(0 if top is None else int(top) + 1).select(F.col("id").cast("int").alias(class_id))
    return ids.join(counts, class_id, "left").select(class_id, F.coalesce("n", F.lit(0)).alias("n"))


def with_label_count(df: DataFrame, label: str, name: str = "label_count") -> DataFrame:
    """Every row with the size of its class; rows without a label are dropped."""
    labelled = df.where(F.col(label).isNotNull())
    return attach(labelled, stored(value_counts(labelled, label, name=name), "label-counts"), [label], null_keys=False)


def label_mapping(df: DataFrame, label: str = "labels") -> DataFrame:
    """``label, label_id``: contiguous ids from 0.

    Numbers are ordered by value. Text is cleaned first, which may merge labels, and ordered
    without regard to case. Numbering runs over the distinct labels only, in ranges of their order.
    """
    values = df.select(label).where(F.col(label).isNotNull()).distinct()
    if dict(values.dtypes)[label] == "string":
        values = values.select(clean_label(F.col(label)).alias("label")).distinct()
        order = folded_order("label")
    else:
        values = values.withColumnRenamed(label, "label")
        order = [F.col("label").asc()]
    numbers = numbered(stored(values, "labels"), order, "label_id", start=0)
    return numbers.select("label", F.col("label_id").cast("int"))


def with_label_id(df: DataFrame, mapping: DataFrame, label: str = "labels") -> DataFrame:
    """Add ``label_id`` by the cleaned form of the label; null for a label that is not mapped."""
    text = dict(mapping.dtypes)["label"] == "string"
    key = clean_label(F.col(label)) if text else F.col(label)
    table = mapping.select(F.col("label").alias("_label"), "label_id")
    joined = attach(df.drop("label_id").withColumn("_label", key), table, ["_label"], "left")
    return joined.select(*[c for c in df.columns if c != "label_id"], "label_id")


def dense_labels(df: DataFrame, label: str = "labels") -> DataFrame:
    """Replace labels by their rank among the distinct labels, from 0."""
    values = stored(df.select(label).distinct(), "labels")
    ranks = numbered(values, [F.col(label).asc()], "_new", start=0)
    numbers = stored(ranks.select(label, F.col("_new").cast("int")), "dense-labels")
    columns = [F.col("_new").alias(c) if c == label else F.col(c) for c in df.columns]
    return attach(df, numbers, [label]).select(*columns)


def align_labels(df: DataFrame, names: DataFrame, target: DataFrame, label_id: str) -> DataFrame:
    """Re-number class ids to a target mapping.

    ``names`` is ``(label_id, label)`` as the table uses it, ``target`` ``(label, label_id)``;
    names meet in lower case.
    """
    wanted = target.select(F.lower("label").alias("_name"), F.col("label_id").alias("_to"))
    known = names.select(F.col("label_id").alias("_from"), F.lower("label").alias("_name"))
    pairs = stored(known.join(wanted, "_name").select(F.col("_from").alias(label_id), "_to"), "aligned-labels")
    columns = [F.col("_to").alias(c) if c == label_id else F.col(c) for c in df.columns]
    return attach(df, pairs, [label_id], "left", null_keys=False).select(*columns)


def encode_classes(df: DataFrame, column: str, include_nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace a column by class ids; returns the rows and the ``(label, label_id)`` table.

    Values are compared as text in plain text order. Nulls stay null, or form the class "None".
    """
    text = F.col(column).cast("string")
    text = F.coalesce(text, F.lit("None")) if include_nulls else text
    coded = df.withColumn("_text", text)
    values = coded.select(F.col("_text").alias("label")).where(F.col("label").isNotNull()).distinct()
    numbers = numbered(stored(values, "labels"), [F.col("label").asc()], "label_id", start=0)
    mapping = stored(numbers.select("label", F.col("label_id").cast("int")), "classes")
    joined = attach(coded, mapping.withColumnRenamed("label", "_text"), ["_text"], "left", null_keys=False)
    columns = [F.col("label_id").alias(c) if c == column else F.col(c) for c in df.columns]
    return joined.select(*columns), mapping


def distinct_per_member(df: DataFrame, column: str, split: str = "split", dataset: str = "dataset") -> DataFrame:
    """Distinct values of a column in every member table."""
    return df.select(split, dataset, column).distinct()


def members_shape(df: DataFrame, split: str = "split", dataset: str = "dataset") -> DataFrame:
    """Rows, columns and column names of every member table."""
    columns = [c for c in df.columns if c not in (split, dataset)]
    counts = df.groupBy(split, dataset).agg(F.count(F.lit(1)).alias("num_rows"))
    return counts.withColumn("num_columns", F.lit(len(columns))).withColumn("column_names", F.lit(",".join(columns)))


def file_stats(packets: DataFrame, file: str, stream: str) -> DataFrame:
    """Rows and flows of every file.

    Flows are grouped first, so that a file with most rows still spreads over many tasks.
    """
    flows = packets.groupBy(file, stream).agg(F.count(F.lit(1)).alias("n"))
    return flows.groupBy(file).agg(F.sum("n").alias("num_rows"), F.count(stream).alias("num_streams"))


def length_by_label(df: DataFrame, label: str, length: str) -> DataFrame:
    """Mean length and row count of every label."""
    return df.groupBy(label).agg(F.avg(length).alias("mean_len"), F.count(F.lit(1)).alias("n"))
