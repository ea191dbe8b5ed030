"""Evaluation metrics and projections on embeddings, document labels and tagged conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.arrays import argmax
from packetloom.operators import metrics, projection
from queries.registry import query, table

# Truth is the class of a vector, the prediction the class with the nearest centroid over all its values.
P = (
    "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), "
    "ce AS (SELECT label AS c, pos, avg(v) AS m FROM x GROUP BY 1, 2), "
    "di AS (SELECT vec_id, label, c, round(sum((v - m) * (v - m)), 9) AS d FROM x JOIN ce USING (pos) GROUP BY 1, 2, 3), "
    "p AS (SELECT vec_id, label, c AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM di) WHERE r = 1), "
    "k AS (SELECT label, pred, count(*) AS n FROM p GROUP BY 1, 2), "
    "cl AS (SELECT label AS c FROM k UNION SELECT pred FROM k), "
    "g AS (SELECT a.c AS label, b.c AS pred, coalesce(k.n, 0)::BIGINT AS n FROM cl a CROSS JOIN cl b LEFT JOIN k ON k.label = a.c AND k.pred = b.c), "
    "t AS (SELECT cl.c AS class, coalesce(sum(n) FILTER (label = pred AND label = cl.c), 0)::DOUBLE AS hit, "
    "coalesce(sum(n) FILTER (label = cl.c), 0)::BIGINT AS support, coalesce(sum(n) FILTER (pred = cl.c), 0)::DOUBLE AS found FROM cl, k GROUP BY 1), "
    "u AS (SELECT class, support, CASE WHEN found > 0 THEN hit / found ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM t), "
    "s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM u) "
)


def predictions(spark, sf_dir):
    return projection.nearest_centroid(table(spark, sf_dir, "embeddings"), "embedding", "label", ["vec_id"])


def counts(spark, sf_dir):
    return metrics.confusion_counts(predictions(spark, sf_dir))


@query("d13_confusion_matrix", P + "SELECT label, pred, n FROM g")
def d13(spark, sf_dir):
    return metrics.confusion_matrix(counts(spark, sf_dir))


REPORT = (
    "w AS (SELECT class::VARCHAR AS class, precision, recall, f1, support::DOUBLE AS support FROM s "
    "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s), "
    "l AS (SELECT class, 'precision' AS metric, precision AS value FROM w UNION ALL SELECT class, 'recall', recall FROM w "
    "UNION ALL SELECT class, 'f1', f1 FROM w UNION ALL SELECT class, 'support', support FROM w "
    "UNION ALL SELECT 'accuracy', 'accuracy', sum(n) FILTER (label = pred) / sum(n)::DOUBLE FROM k) "
)


@query("d14_classification_report", P + ", " + REPORT + "SELECT class, metric, round(value, 6) AS value FROM l")
def d14(spark, sf_dir):
    return metrics.report(counts(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("d14_flat_report", P + ", " + REPORT + "SELECT class || '_' || metric AS name, round(value, 6) AS value FROM l")
def d14b(spark, sf_dir):
    return metrics.flat_report(metrics.report(counts(spark, sf_dir))).withColumn("value", F.round("value", 6))


@query(
    "d15_weighted_scores",
    P + "SELECT round((SELECT sum(n) FILTER (label = pred) / sum(n)::DOUBLE FROM k), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, "
    "round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM s",
)
def d15(spark, sf_dir):
    row = metrics.summary(counts(spark, sf_dir))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    "d16_normalised_confusion",
    P + "SELECT label, pred, round(share, 6) AS share FROM (SELECT label, pred, n / nullif(sum(n) OVER (PARTITION BY label), 0)::DOUBLE AS share FROM g) "
    "WHERE label < 8 AND pred < 8",
)
def d16(spark, sf_dir):
    shares = metrics.normalised_confusion(metrics.confusion_matrix(counts(spark, sf_dir)), max_classes=8)
    return shares.withColumn("share", F.round("share", 6))


@query(
    "d16_normalised_confusion_literal",
    P + "SELECT g.label, g.pred, round(g.n / nullif(r.t, 0)::DOUBLE, 6) AS share FROM g JOIN (SELECT label, sum(n) AS t FROM g GROUP BY 1) r ON r.label = g.pred",
)
def d16b(spark, sf_dir):
    shares = metrics.normalised_confusion(metrics.confusion_matrix(counts(spark, sf_dir)), literal=True)
    return shares.withColumn("share", F.round("share", 6))


@query(
    "d22_accumulated_metrics",
    "WITH k AS (SELECT quality AS label, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2) "
    "SELECT label, pred, n FROM k",
)
def d22(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    batches = [metrics.confusion_counts(rows.where(F.col("doc_id") % 3 == i), "quality", "toxic") for i in range(3)]
    return metrics.accumulated(*batches)


@query(
    "d22_accumulated_accuracy",
    "SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels",
)
def d22b(spark, sf_dir):
    return metrics.summary(d22(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


TOKENS = (
    "t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\\s+')) AS token, "
    "unnest(range(0, len(regexp_split_to_array(text, '\\s+'))))::INT AS pos FROM conversations), "
    "y AS (SELECT conv_id, turn, pos, CASE WHEN NOT regexp_matches(token, '^[A-Z]') THEN 'O' WHEN length(token) > 4 THEN 'B-LONG' ELSE 'I-SHORT' END AS truth, "
    "CASE WHEN NOT regexp_matches(token, '^[A-Z][a-z]') THEN 'O' WHEN length(token) > 5 THEN 'I-LONG' ELSE 'I-SHORT' END AS guess FROM t) "
)


def spans_sql(tag: str) -> str:
    return (
        f"(SELECT conv_id, turn, kind, min(pos) AS s, max(pos) AS e FROM (SELECT *, sum(b) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS g FROM "
        f"(SELECT conv_id, turn, pos, CASE WHEN {tag} <> 'O' THEN substr({tag}, 3) END AS kind, CASE WHEN {tag} <> 'O' AND ({tag} LIKE 'B-%' OR "
        f"lag(substr({tag}, 3)) OVER (PARTITION BY conv_id, turn ORDER BY pos) IS DISTINCT FROM substr({tag}, 3)) THEN 1 ELSE 0 END AS b FROM y)) "
        "WHERE kind IS NOT NULL GROUP BY conv_id, turn, kind, g)"
    )


@query(
    "d23_entity_scores",
    "WITH " + TOKENS + f", a AS {spans_sql('truth')}, b AS {spans_sql('guess')}, "
    "h AS (SELECT coalesce(a.kind, b.kind) AS kind, count(a.s) AS support, count(b.s) AS found, count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS hit "
    "FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.kind = b.kind AND a.s = b.s AND a.e = b.e GROUP BY 1), "
    "z AS (SELECT * FROM h UNION ALL SELECT 'all', sum(support), sum(found), sum(hit) FROM h), "
    "q AS (SELECT kind, support::BIGINT AS support, CASE WHEN found > 0 THEN hit / found::DOUBLE ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS r FROM z) "
    "SELECT kind, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM q",
)
def d23(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("pos", "token"))
    token = F.col("token")
    truth = F.when(~token.rlike("^[A-Z]"), "O").when(F.length(token) > 4, "B-LONG").otherwise("I-SHORT")
    guess = F.when(~token.rlike("^[A-Z][a-z]"), "O").when(F.length(token) > 5, "I-LONG").otherwise("I-SHORT")
    keys = ["conv_id", "turn"]
    sides = [metrics.entity_spans(tokens.withColumn("tag", tag), keys, "pos", "tag") for tag in (truth, guess)]
    scores = metrics.entity_scores(*sides, keys)
    return scores.select("kind", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "d17_class_centroids",
    "SELECT label, pos, round(avg(v), 6) AS center FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64))::INT AS pos FROM embeddings) GROUP BY 1, 2",
)
def d17(spark, sf_dir):
    centers = projection.centroids(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return centers.withColumn("center", F.round("center", 6))


@query(
    "d18_min_max_scaled",
    "SELECT vec_id, pos, round(CASE WHEN h > l THEN (v - l) / (h - l) ELSE 0 END, 6) AS scaled FROM (SELECT *, min(v) OVER (PARTITION BY pos) AS l, "
    "max(v) OVER (PARTITION BY pos) AS h FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64))::INT AS pos FROM embeddings))",
)
def d18(spark, sf_dir):
    scaled = projection.min_max_scaled(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    return scaled.withColumn("scaled", F.round("scaled", 6))


@query(
    "d19_principal_components",
    "SELECT c.c AS component, count(*) AS n, TRUE AS share_of_variance, TRUE AS uncorrelated "
    "FROM embeddings, (VALUES (0), (1)) c(c) GROUP BY 1",
)
def d19(spark, sf_dir):
    """Each share is the variance of the projected values in that of all values, and components don't correlate."""
    vectors = table(spark, sf_dir, "embeddings")
    projected, shares = projection.principal_components(vectors, "embedding", 2)
    total = projection.components(vectors, "embedding").groupBy("pos").agg(F.var_samp("value").alias("v")).agg(F.sum("v").alias("total"))
    first, second = F.col("projected")[0], F.col("projected")[1]
    seen = projected.agg(F.count("*").alias("n"), F.array(F.var_samp(first), F.var_samp(second)).alias("v"), F.corr(first, second).alias("r"))
    met = shares.join(seen.join(total, F.lit(True)), F.lit(True))  # one row each, and one for each component
    share = F.abs(F.element_at("v", F.col("component") + 1) / F.col("total") - F.col("explained")) < 1e-9
    return met.select("component", "n", share.alias("share_of_variance"), (F.abs("r") < 1e-6).alias("uncorrelated"))


@query(
    "t1_train_classifier",
    "SELECT sum(floor(c * 0.2))::BIGINT AS n_test, count(*) AS n_classes, TRUE AS fits_training "
    "FROM (SELECT label, count(*) AS c FROM embeddings WHERE label IS NOT NULL GROUP BY 1)",
)
def t1(spark, sf_dir):
    from packetloom.operators.sampling import split_exact

    parts = split_exact(table(spark, sf_dir, "embeddings"), ["vec_id"], 0.2, "label")
    model = projection.train_classifier(parts.where("part = 'train'"), "embedding", "label", grid=[0.001, 0.1])
    scored = projection.score(model, parts.where("part = 'test'"), "embedding", "label", ["vec_id"])
    known = projection.score(model, parts.where("part = 'train'"), "embedding", "label", ["vec_id"])
    hits = known.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("hits"))
    fit = hits.agg((F.sum("hits") > F.max("n")).alias("fits_training"))  # better than the largest class alone
    seen = scored.where(F.col("pred").isNotNull()).agg(F.count("*").alias("n_test"), F.countDistinct("label").alias("n_classes"))
    return seen.join(fit, F.lit(True))


@query("d19_explained_shares")
def d19b(spark, sf_dir):
    """The shares of variance themselves; SQL checks them by their properties above, the tests against numpy."""
    return projection.principal_components(table(spark, sf_dir, "embeddings"), "embedding", 2)[1]


@query("t1_test_report")
def t1b(spark, sf_dir):
    """Scores of the classifier on its test rows, class by class and together."""
    from packetloom.operators.sampling import split_exact

    parts = split_exact(table(spark, sf_dir, "embeddings"), ["vec_id"], 0.2, "label")
    model = projection.train_classifier(parts.where("part = 'train'"), "embedding", "label", grid=[0.001, 0.1])
    scored = projection.score(model, parts.where("part = 'test'"), "embedding", "label", ["vec_id"])
    return metrics.report(metrics.confusion_counts(scored))


@query("t2_scores")
def t2b(spark, sf_dir):
    """Prediction, class probabilities and vector of every row."""
    vectors = table(spark, sf_dir, "embeddings")
    return projection.score(projection.train_classifier(vectors, "embedding", "label"), vectors, "embedding", "label", ["vec_id"])


@query(
    "t2_score_table",
    "SELECT vec_id, label, len(embedding)::INTEGER AS width, TRUE AS sums_to_one, TRUE AS pred_is_best FROM embeddings",
)
def t2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    scored = projection.score(projection.train_classifier(vectors, "embedding", "label"), vectors, "embedding", "label", ["vec_id"])
    one = F.abs(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    best = F.element_at("scores", F.col("pred") + 1) == F.array_max("scores")
    return scored.select("vec_id", "label", F.size("latent").alias("width"), one.alias("sums_to_one"), best.alias("pred_is_best"))
