"""Latent vectors: centroids, scaling, principal components; training and scoring of classifiers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel, Predictor
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from packetloom.functions.wide import moments_arrow
from packetloom.operators.stored import attach, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def components(df: DataFrame, vector: str, *carry: str) -> DataFrame:
    """One row per dimension: ``carry, pos, value``."""
    return df.select(*carry, F.posexplode(vector).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all vectors of a column (NaN for null), the row of each, and its place in its vector."""
    lists = column.cast(pa.large_list(pa.float64())).fill_null([])
    starts = np.asarray(lists.offsets)
    row = np.repeat(np.arange(len(lists)), np.diff(starts))
    return np.asarray(lists.flatten().cast(pa.float64()), float), row, np.arange(starts[0], starts[-1]) - starts[:-1][row]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of a batch and dimension: sum, number, least and greatest of the values that are there."""
    for batch in batches:
        value, row, pos = _flat(batch.column(1))
        there = ~np.isnan(value)
        value, row, pos = value[there], row[there], pos[there]
        if not len(value):
            continue
        coded = batch.column(0).dictionary_encode()
        # A null class is one like others, the last.
        code = np.asarray(coded.indices.fill_null(len(coded.dictionary)))[row].astype(np.int64)
        cells, cell = np.unique(code * (pos.max() + 1) + pos, return_inverse=True)
        least, greatest = np.full(len(cells), np.inf), np.full(len(cells), -np.inf)
        np.minimum.at(least, cell, value)
        np.maximum.at(greatest, cell, value)
        which = cells // (pos.max() + 1)
        classes = coded.dictionary.take(pa.array(which, mask=which == len(coded.dictionary)))
        columns = [classes, pa.array((cells % (pos.max() + 1)).astype(np.int32)), pa.array(np.bincount(cell, value)), pa.array(np.bincount(cell)), pa.array(least), pa.array(greatest)]
        yield pa.RecordBatch.from_arrays(columns, ["class", "pos", "sum", "n", "low", "high"])


def _class_sums(df: DataFrame, vector: str, label: Column) -> DataFrame:
    """Sums of :func:`_sums` over the table: a row per class and dimension leaves a batch, not one per value."""
    slim = df.select(label.alias("class"), F.col(vector).cast("array<double>").alias("v"))
    kind = slim.schema["class"].dataType.simpleString()
    made = slim.mapInArrow(_sums, f"class {kind}, pos int, sum double, n long, low double, high double")
    return made.groupBy("class", "pos").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean of every dimension per class: ``label, pos, center``. Nulls and NaN count as missing values."""
    return _class_sums(df, vector, F.col(label)).select(F.col("class").alias(label), "pos", (F.col("sum") / F.col("n")).alias("center"))


def nearest_centroid(df: DataFrame, vector: str, label: str, ids: list[str], most_values: int = 4_000_000) -> DataFrame:
    """``ids, label, pred``: the class whose centroid is nearest, ties within 1e-9 to the smaller class.

    Classes times dimensions are counted: up to ``most_values`` centers go to the tasks, which compare whole batches with
    one class after the other. Beyond, vectors meet the centers by dimension in a join, with as many rows
    as values times classes, summed before the shuffle where a vector's dimensions are together.
    """
    centers = stored(centroids(df, vector, label).withColumnRenamed(label, "_class"), "centroids")
    if centers.count() <= most_values:
        return _nearest(df, vector, label, ids, centers)
    own = components(df, vector, *ids, label)
    step = F.col("value") - F.col("center")
    distance = F.round(F.sum(step * step), 9)
    far = own.join(centers, "pos").groupBy(*ids, label, "_class").agg(distance.alias("_d"))
    return far.groupBy(*ids, label).agg(F.min_by("_class", F.struct("_d", "_class")).alias("pred"))


def _nearest(df: DataFrame, vector: str, label: str, ids: list[str], centers: DataFrame) -> DataFrame:
    rows = centers.where("_class is not null").orderBy("_class", "pos").collect()
    classes = list(dict.fromkeys(r["_class"] for r in rows))
    place, width = {c: i for i, c in enumerate(classes)}, max((r["pos"] for r in rows), default=-1) + 1
    table = np.full((len(classes), width), np.nan)
    for r in rows:
        table[place[r["_class"]], r["pos"]] = r["center"]
    slim = df.select(*ids, F.col(label).alias(label), F.col(vector).cast("array<double>").alias("_v"))
    kind = centers.schema["_class"].dataType
    out = T.StructType([*slim.schema.fields[:-1], T.StructField("pred", kind)])
    names = pa.array(classes, to_arrow_type(kind))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, row, pos = _flat(batch.column(batch.num_columns - 1))
            own = np.full((batch.num_rows, width), np.nan)
            inside = pos < width
            own[row[inside], pos[inside]] = value[inside]
            best, pred = np.full(batch.num_rows, np.inf), np.full(batch.num_rows, -1)
            for number, center in enumerate(table):
                step = own - center
                met = ~np.isnan(step)
                far = np.round(np.where(met, step, 0) ** 2 @ np.ones(width), 9)
                nearer = (far < best) & met.any(axis=1)
                best[nearer], pred[nearer] = far[nearer], number
            found = names.take(pa.array(pred, mask=pred < 0))
            some = pa.array(pred >= 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], out.names).filter(some)

    return slim.mapInArrow(compare, out) if classes else slim.drop("_v").withColumn("pred", F.lit(None).cast(kind)).where("false")


def min_max_scaled(df: DataFrame, vector: str, ids: list[str]) -> DataFrame:
    """Every dimension scaled to [0, 1] over the table, a constant one to 0: ``ids, pos, scaled``."""
    long = components(df, vector, *ids)
    ranges = stored(_class_sums(df, vector, F.lit(0)).select("pos", "low", "high"), "ranges")
    width = F.col("high") - F.col("low")
    scaled = F.when(width > 0, (F.col("value") - F.col("low")) / width).otherwise(F.lit(0.0))
    return attach(long, ranges, ["pos"]).select(*ids, "pos", scaled.alias("scaled"))


def principal_components(df: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``projected`` array, and ``(component, explained)`` variance shares.

    Vectors are centred first. The sign of a component is arbitrary.
    """
    vectors = df.withColumn("_v", array_to_vector(F.col(vector)))
    center = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False)
    model = Pipeline(stages=[center, PCA(k=k, inputCol="_c", outputCol="_p")]).fit(vectors)
    projected = model.transform(vectors).withColumn("projected", vector_to_array("_p")).drop("_v", "_c", "_p")
    shares = [(i, float(v)) for i, v in enumerate(model.stages[-1].explainedVariance)]
    return projected, df.sparkSession.createDataFrame(shares, "component int, explained double")


def train_classifier(
    df: DataFrame,
    vector: str,
    label: str,
    estimator: Predictor | None = None,
    grid: list[dict] | list[float] | None = None,
    folds: int = 2,
    seed: int = 42,
) -> PipelineModel | CrossValidatorModel:
    """A classifier on an array column; multinomial logistic regression unless another is given.

    The number of classes comes from the data. With a grid - regularisation strengths, or settings
    as ``{param: value}`` - the best model by F1 under cross-validation is returned.
    """
    df = df.withColumn("features", array_to_vector(F.col(vector)))
    classifier = estimator or LogisticRegression(maxIter=20, family="multinomial")
    classifier = classifier.copy().setFeaturesCol("features").setLabelCol(label)
    if not grid:
        return Pipeline(stages=[classifier]).fit(df)
    settings = [g if isinstance(g, dict) else {"regParam": g} for g in grid]
    params = [{classifier.getParam(name): value for name, value in g.items()} for g in settings]
    best_f1 = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    search = CrossValidator(estimator=classifier, estimatorParamMaps=params, evaluator=best_f1, numFolds=folds, seed=seed)
    return search.fit(df)


def score(model: PipelineModel | CrossValidatorModel, df: DataFrame, vector: str, label: str, ids: list[str]) -> DataFrame:
    """``ids, label, pred, scores, latent`` of every row."""
    vectors = df.withColumn("features", array_to_vector(F.col(vector)))
    return model.transform(vectors).select(
        *ids,
        F.col(label).alias("label"),
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("scores"),
        F.col(vector).alias("latent"),
    )


def mean_and_deviation(df: DataFrame, values: str, first: int | None = None, order: str | None = None) -> DataFrame:
    """One row ``mean, std, pooled_std`` of an array column.

    The first two average the rows' own means and sample deviations; the last is the sample
    deviation of all values together. ``first`` limits to the leading rows by ``order``.
    """
    df = df.select(*([order] if order else []), values)
    if first is not None:
        df = df.orderBy(order).limit(first)
    rows = df.select(moments_arrow(F.col(values).cast("array<double>")).alias("s")).select("s.*")
    n, m = F.col("n"), F.col("m")
    squares = F.sum(F.col("var") * (n - 1)) + F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)
    return rows.agg(
        F.avg(m).alias("mean"), F.avg(F.sqrt("var")).alias("std"), F.sqrt(squares / (F.sum(n) - 1)).alias("pooled_std")
    )
