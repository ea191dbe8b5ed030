"""Evaluation of predictions: confusion counts and everything derived from them.

Predictions are counted once per (label, pred), with partial aggregation; all metrics then work on
that small table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.stored import stored


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Occurring pairs only: ``label, pred, n``."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accumulated(*counts: DataFrame) -> DataFrame:
    """Sum of partial confusion counts."""
    together = reduce(lambda a, b: a.unionByName(b), counts)
    return together.groupBy("label", "pred").agg(F.sum("n").alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """The full class x class grid, zeros included: ``label, pred, n``."""
    counts = stored(counts, "confusion")
    classes = counts.select(F.explode(F.array("label", "pred")).alias("c")).agg(F.sort_array(F.collect_set("c")).alias("cs"))
    grid = classes.select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("pred"))
    joined = grid.join(counts, ["label", "pred"], "left")
    return joined.select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(counts: DataFrame) -> DataFrame:
    """Per class: ``class, precision, recall, f1, support``; a score without cases is 0."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), hit.alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hit", "support", "predicted")])
    scores = sums.select(
        "class",
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        "support",
    )
    p, r = F.col("precision"), F.col("recall")
    return scores.withColumn("f1", _ratio(2 * p * r, p + r))


def summary(counts: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    scores = class_scores(counts)
    weight = F.sum("support")
    weighted = [(F.sum(F.col(m) * F.col("support")) / weight).alias(m) for m in ("precision", "recall", "f1")]
    hits = F.sum(F.col("recall") * F.col("support")) / weight
    return scores.agg(hits.alias("accuracy"), *weighted)


def report(counts: DataFrame) -> DataFrame:
    """Classification report in long form: ``class, metric, value``.

    Besides the classes there are ``accuracy``, ``macro avg`` and ``weighted avg``.
    """
    scores = stored(class_scores(counts), "class-scores")
    metrics = ["precision", "recall", "f1", "support"]
    named = scores.withColumn("class", F.col("class").cast("string"))
    support = F.sum("support")
    macro = [F.avg(m).alias(m) for m in metrics[:3]]
    weighted = [(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in metrics[:3]]
    macro_row = scores.agg(*macro, support.alias("support")).withColumn("class", F.lit("macro avg"))
    weighted_row = scores.agg(*weighted, support.alias("support")).withColumn("class", F.lit("weighted avg"))
    wide = named.select("class", *metrics).unionByName(macro_row).unionByName(weighted_row)
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = wide.select("class", F.explode(values).alias("v")).select("class", "v.metric", "v.value")
    hits = (F.sum(F.col("recall") * F.col("support")) / support).alias("value")
    accuracy = scores.agg(hits).select(F.lit("accuracy").alias("class"), F.lit("accuracy").alias("metric"), "value")
    return long.unionByName(accuracy)


def flat_report(report_rows: DataFrame) -> DataFrame:
    """The report with ``{class}_{metric}`` keys: ``name, value``."""
    return report_rows.select(F.concat_ws("_", "class", "metric").alias("name"), "value")


def normalised_confusion(matrix: DataFrame, literal: bool = False, max_classes: int | None = None) -> DataFrame:
    """Confusion counts as shares of the true class: ``label, pred, share``.

    ``literal`` divides column j by the total of row j instead. ``max_classes`` keeps the leading
    class ids after normalising.
    """
    if literal:
        rows = matrix.groupBy(F.col("label").alias("pred")).agg(F.sum("n").alias("_total"))
        df = matrix.join(rows, "pred")
    else:
        df = matrix.withColumn("_total", F.sum("n").over(Window.partitionBy("label")))
    share = F.when(F.col("_total") > 0, F.col("n") / F.col("_total"))
    df = df.select("label", "pred", share.alias("share"))
    if max_classes is not None:
        df = df.where((F.col("label") < max_classes) & (F.col("pred") < max_classes))
    return df


def entity_spans(tags: DataFrame, keys: list[str], pos: str, tag: str) -> DataFrame:
    """Entities in BIO-tagged sequences: ``keys, kind, start, end``.

    A span starts at B-x, or at an I-x that does not continue an x.
    """
    kind = F.when(F.col(tag) != "O", F.expr(f"substring({tag}, 3)"))
    order = Window.partitionBy(*keys).orderBy(pos)
    df = tags.select(*keys, pos, F.col(tag).alias("_tag"), kind.alias("kind"))
    before = F.lag("kind").over(order)
    begins = F.col("kind").isNotNull() & (F.col("_tag").startswith("B-") | before.isNull() | (before != F.col("kind")))
    df = df.withColumn("_begin", begins.cast("int")).withColumn("_span", F.sum("_begin").over(order))
    spans = df.where(F.col("kind").isNotNull()).groupBy(*keys, "_span", "kind")
    return spans.agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("_span")


def entity_scores(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 per entity kind and overall, on exactly equal spans."""
    span = [*keys, "kind", "start", "end"]
    sides = truth.select(*span, F.lit(1).alias("t"), F.lit(0).alias("p")).union(
        pred.select(*span, F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    merged = sides.groupBy(*span).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    both = F.least("t", "p")
    kinds = merged.groupBy("kind").agg(F.sum("t").alias("support"), F.sum("p").alias("found"), F.sum(both).alias("hit"))
    total = kinds.agg(*[F.sum(c).alias(c) for c in ("support", "found", "hit")]).select(F.lit("all").alias("kind"), "*")
    scores = kinds.unionByName(total).select(
        "kind",
        _ratio(F.col("hit"), F.col("found")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        "support",
    )
    p, r = F.col("precision"), F.col("recall")
    return scores.withColumn("f1", _ratio(2 * p * r, p + r))
