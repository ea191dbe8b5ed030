from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from packetloom.operators import labels, metrics, projection


def counts(spark, refs, preds):
    return metrics.confusion_counts(spark.createDataFrame(list(zip(refs, preds)), "label int, pred int"))


def test_accuracy_row_by_row_and_by_batch(spark):
    parts = [counts(spark, [r], [p]) for r, p in zip([0, 1, 0, 1], [1, 0, 0, 1])]
    assert metrics.summary(metrics.accumulated(*parts)).first()["accuracy"] == 0.5
    halves = [counts(spark, [0, 1], [1, 0]), counts(spark, [0, 1], [0, 1])]
    assert metrics.summary(metrics.accumulated(*halves)).first()["accuracy"] == 0.5


def test_combined(spark):
    c = counts(spark, [0, 1, 1], [0, 1, 0])
    row = {r["class"]: r for r in metrics.class_scores(c).collect()}[1]
    assert (row["precision"], row["recall"], row["f1"], row["support"]) == (1, 0.5, pytest.approx(2 / 3), 2)
    grid = {(r["label"], r["pred"]): r["n"] for r in metrics.confusion_matrix(c).collect()}
    assert grid == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 1}


def test_random_report(spark):
    rng = random.Random(2)
    refs, preds = [rng.randrange(5) for _ in range(300)], [rng.randrange(6) for _ in range(300)]
    report = {(r["class"], r["metric"]): r["value"] for r in metrics.report(counts(spark, refs, preds)).collect()}
    f1s, supports = [], []
    for c in range(6):
        hit = sum(a == b == c for a, b in zip(refs, preds))
        p, r = hit / max(preds.count(c), 1), hit / max(refs.count(c), 1)
        f1 = 2 * p * r / (p + r) if p + r else 0
        assert report[str(c), "precision"] == pytest.approx(p) and report[str(c), "recall"] == pytest.approx(r)
        f1s.append(f1)
        supports.append(refs.count(c))
    assert report["5", "recall"] == 0 == report["5", "support"]
    assert report["accuracy", "accuracy"] == pytest.approx(sum(a == b for a, b in zip(refs, preds)) / 300)
    assert report["macro avg", "f1"] == pytest.approx(sum(f1s) / 6)
    assert report["weighted avg", "f1"] == pytest.approx(sum(f * s for f, s in zip(f1s, supports)) / 300)
    assert "weighted avg_f1" in {r["name"] for r in metrics.flat_report(metrics.report(counts(spark, refs, preds))).collect()}


def test_normalised(spark):
    matrix = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 0, 2), (1, 1, 2), (2, 0, 0), (2, 1, 0)], "label int, pred int, n long")
    mine = {(r["label"], r["pred"]): r["share"] for r in metrics.normalised_confusion(matrix).collect()}
    assert mine == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.5, (2, 0): None, (2, 1): None}
    square = matrix.where("label < 2").withColumn("n", F.when((F.col("label") == 1) & (F.col("pred") == 1), 6).otherwise(F.col("n")))
    literal = {(r["label"], r["pred"]): r["share"] for r in metrics.normalised_confusion(square, literal=True).collect()}
    assert literal == {(0, 0): 0.75, (0, 1): 0.125, (1, 0): 0.5, (1, 1): 0.75}


def test_entities(spark):
    refs = [["O", "O", "O", "B-MISC", "I-MISC", "I-MISC", "O"], ["B-PER", "I-PER", "O"]]
    preds = [["O", "O", "B-MISC", "I-MISC", "I-MISC", "I-MISC", "O"], ["B-PER", "I-PER", "O"]]

    def spans(tags):
        rows = [(i, j, t) for i, seq in enumerate(tags) for j, t in enumerate(seq)]
        return metrics.entity_spans(spark.createDataFrame(rows, "seq int, pos int, tag string"), ["seq"], "pos", "tag")

    scores = {r["kind"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.entity_scores(spans(refs), spans(preds), ["seq"]).collect()}
    assert scores == {"MISC": (0, 0, 0), "PER": (1, 1, 1), "all": (0.5, 0.5, 0.5)}
    starts = spans([["I-A", "I-B", "B-B", "O", "I-B"]]).collect()
    assert sorted((r["kind"], r["start"], r["end"]) for r in starts) == [("A", 0, 0), ("B", 1, 1), ("B", 2, 2), ("B", 4, 4)]


def test_departments(spark):
    df = spark.createDataFrame([(d,) for d in ["IT", "CS", "CS", "IT", "ECE", "ECE", "CS", "Mech"]], "dept string")
    assert {r["dept"]: r["count"] for r in labels.value_counts(df, "dept").collect()} == {"CS": 3, "IT": 2, "ECE": 2, "Mech": 1}
    assert tuple(labels.smallest_class(df, "dept", 10).first()) == (1, 10)
    assert [r["dept"] for r in labels.label_distribution(df, "dept").collect()] == ["CS", "ECE", "IT", "Mech"]


def test_label_mapping_merges_cleaned_labels(spark):
    df = spark.createDataFrame([("b-1",), ("B 2",), ("b_1",), ("a",), (None,)], "labels string")
    mapping = labels.label_mapping(df)
    assert sorted((r["label_id"], r["label"]) for r in mapping.collect()) == [(0, "a"), (1, "b_1"), (2, "B_2")]
    ids = {r["labels"]: r["label_id"] for r in labels.with_label_id(df, mapping).collect()}
    assert ids == {"b-1": 1, "b_1": 1, "B 2": 2, "a": 0, None: None}
    numbers = spark.createDataFrame([(30,), (4,), (4,)], "labels int")
    assert sorted(map(tuple, labels.label_mapping(numbers).collect())) == [(4, 0), (30, 1)]
    assert {r["labels"]: r["label_id"] for r in labels.with_label_id(numbers, labels.label_mapping(numbers)).collect()} == {30: 1, 4: 0}


def test_histogram_has_the_gaps(spark):
    df = spark.createDataFrame([(0,), (3,), (3,)], "c int")
    assert sorted(map(tuple, labels.dense_histogram(df, "c").collect())) == [(0, 1), (1, 0), (2, 0), (3, 2)]


def test_projection(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (80, 5)) * [5, 2, 0.1, 0.1, 0], rng.normal(3, 1, (80, 5)) * [5, 2, 0.1, 0.1, 0]])
    df = spark.createDataFrame([(i, i // 80, v.tolist()) for i, v in enumerate(x)], "id int, label int, v array<double>")
    projected, shares = projection.principal_components(df, "v")
    var = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["explained"] for r in shares.orderBy("component").collect()] == pytest.approx(list(var[:2] / var.sum()))
    p = np.array([r["projected"] for r in projected.orderBy("id").collect()])
    assert p.mean(axis=0) == pytest.approx([0, 0], abs=1e-9) and p.var(axis=0, ddof=1) == pytest.approx(var[:2])
    centers = {(r["label"], r["pos"]): r["center"] for r in projection.centroids(df, "v", "label").collect()}
    assert centers[1, 0] == pytest.approx(x[80:, 0].mean())
    scaled = {(r["id"], r["pos"]): r["scaled"] for r in projection.min_max_scaled(df, "v", ["id"]).collect()}
    assert scaled[7, 4] == 0 and scaled[7, 1] == pytest.approx((x[7, 1] - x[:, 1].min()) / np.ptp(x[:, 1]))


def test_classifier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, (rng.normal(0, 0.3, 4) + np.eye(4)[i % 3] * 3).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    scored = projection.score(projection.train_classifier(df, "v", "label", grid=[0.01, 10.0]), df, "v", "label", ["id"])
    assert metrics.summary(metrics.confusion_counts(scored)).first()["f1"] > 0.98
    forest = projection.train_classifier(df, "v", "label", RandomForestClassifier(seed=1), grid=[{"numTrees": 5}, {"maxDepth": 2}])
    assert metrics.summary(metrics.confusion_counts(projection.score(forest, df, "v", "label", ["id"]))).first()["f1"] > 0.95
    row = scored.first()
    assert len(row["scores"]) == 3 and sum(row["scores"]) == pytest.approx(1)


def test_mean_and_deviation(spark):
    x = [[1.0, 2.0, 4.0], [3.0, 3.0, 9.0], [0.0, 0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "id int, v array<double>")
    row = projection.mean_and_deviation(df, "v").first()
    a = np.array(x)
    assert (row["mean"], row["std"], row["pooled_std"]) == pytest.approx((a.mean(), a.std(axis=1, ddof=1).mean(), a.std(ddof=1)))
    assert projection.mean_and_deviation(df, "v", first=2, order="id").first()["mean"] == pytest.approx(a[:2].mean())


def test_vector_work_by_batches(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 17 == 0 else "xyz"[i % 3], [float(v) for v in rng.normal(i % 3, 1, 6)]) for i in range(300)]
    rows += [(900, "x", None), (901, "x", []), (902, "y", [None, 1.0, float("nan")]), (903, "w", [5.0]), (904, "z", [0.0] * 9)]
    df = spark.createDataFrame(rows, "id int, label string, v array<double>").repartition(4)
    sums, by_pos = {}, {}
    for _, label, v in rows:
        for pos, x in enumerate(v or []):
            if x is not None and x == x:
                sums.setdefault((label, pos), []).append(x)
                by_pos.setdefault(pos, []).append(x)
    got = {(r["label"], r["pos"]): r["center"] for r in projection.centroids(df, "v", "label").collect()}
    assert got.keys() == sums.keys()
    assert all(got[k] == pytest.approx(np.mean(v)) for k, v in sums.items())
    near = {}
    for i, label, v in rows:
        far = {}
        for c in "wxyz":
            steps = [(x - np.mean(sums[c, pos])) ** 2 for pos, x in enumerate(v or []) if x is not None and x == x and (c, pos) in sums]
            if steps:
                far[c] = round(sum(steps), 9)
        if far:
            near[i] = min(far, key=lambda c: (far[c], c))
    found = {r["id"]: r["pred"] for r in projection.nearest_centroid(df, "v", "label", ["id"]).collect()}
    assert found == near
    complete = df.where("id < 900 and label is not null")
    joined = {r["id"]: r["pred"] for r in projection.nearest_centroid(complete, "v", "label", ["id"], most_values=0).collect()}
    batch = {r["id"]: r["pred"] for r in projection.nearest_centroid(complete, "v", "label", ["id"]).collect()}
    assert joined == batch and len(joined) > 250
    scaled = {(r["id"], r["pos"]): r["scaled"] for r in projection.min_max_scaled(df.where("id < 900"), "v", ["id"]).collect()}
    column = np.array([v for i, _, v in rows if i < 900])
    assert scaled[5, 2] == pytest.approx((rows[5][2][2] - column[:, 2].min()) / np.ptp(column[:, 2]))
