"""Byte and array functions over document texts, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import arrays, octets, wide
from packetloom.functions.hashing import hash_key
from packetloom.operators.labels import value_counts
from queries.registry import features, features_sql, query, table

D = f"WITH d AS ({features_sql()}) "

# Hex of the 1024-byte feature, its byte values as a list, and the values divided by 255.
CROPPED = "f AS (SELECT *, rpad(substr(hx, 1, 2048), 2048, '0') AS fx FROM d)"
VALUES = (
    CROPPED + ", b AS (SELECT doc_id, labels, feature_len, fx, list_transform(range(0, 1024), "
    "lambda i: ('0x' || substr(fx, i * 2 + 1, 2))::INT) AS v FROM f)"
)


def joined(a):
    return F.array_join(F.transform(a, lambda v: v.cast("string")), ",")


def rounded(a, digits: int = 6):
    """Numbers as one text, rounded as whole millionths so that both engines print alike."""
    return F.array_join(F.transform(a, lambda v: F.round(v * 10**digits).cast("long").cast("string")), ",")


def rounded_sql(a: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({a}, lambda v: round(v * {10**digits})::BIGINT), ',')"


@query(
    "h1_hex_to_bytes",
    "SELECT doc_id, CASE WHEN length(t) % 2 = 1 THEN substr(t, 1, length(t) - 1) || '0' || right(t, 1) ELSE t END AS packet FROM "
    "(SELECT doc_id, lower(hex(encode(text))) || CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE '' END AS t FROM documents)",
)
def h1(spark, sf_dir):
    text = F.concat(F.lower(F.hex(F.encode("text", "utf-8"))), F.when(F.col("doc_id") % 2 == 0, "c").otherwise(""))
    docs = table(spark, sf_dir, "documents").withColumn("t", text)
    return docs.select("doc_id", octets.hex_text(octets.from_hex("t", on_odd="nibble")).alias("packet"))


@query("h2_bytes_to_hex", D + "SELECT doc_id, hx FROM d")
def h2(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", octets.hex_text("x").alias("hx"))


@query("h3_byte_length", D + "SELECT doc_id, feature_len::INT AS n FROM d")
def h3(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", octets.byte_length("x").alias("n"))


@query(
    "b7_crop_and_pad",
    D + ", " + CROPPED + " SELECT doc_id, fx AS x, least(feature_len, 1024) AS feature_len FROM f",
)
def b7(spark, sf_dir):
    x = F.col("x")
    return features(spark, sf_dir).select(
        "doc_id", octets.hex_text(octets.crop_and_pad(x)).alias("x"), octets.cropped_length(x).alias("feature_len")
    )


@query("b9_snap_length", D + "SELECT doc_id, substr(hx, 1, 444) AS packet, feature_len AS wire_len FROM d")
def b9(spark, sf_dir):
    from packetloom.operators.packets import snapped

    packets = features(spark, sf_dir).select("doc_id", F.col("x").alias("packet"), F.col("feature_len").alias("wire_len"))
    return snapped(packets).withColumn("packet", octets.hex_text("packet"))


@query(
    "b15_hex_search",
    D + "SELECT doc_id, contains(hx, '0616e') AS anywhere, regexp_matches(hx, '^(?:[0-9a-f]{2})*616e64') AS aligned FROM d",
)
def b15(spark, sf_dir):
    from packetloom.operators.search import contains_hex

    x = F.col("x")
    return features(spark, sf_dir).select(
        "doc_id", contains_hex(x, "0616e").alias("anywhere"), contains_hex(x, "616e64", byte_aligned=True).alias("aligned")
    )


@query(
    "h4_unit_floats",
    D + ", " + VALUES + " SELECT doc_id, array_to_string(v, ',') AS octets, round(list_sum(list_transform(v, lambda x: x / 255.0::DOUBLE)), 6) "
    "AS total FROM b",
)
def h4(spark, sf_dir):
    values = wide.unit_floats_arrow(F.col("x"))
    whole = F.transform(F.col("v"), lambda v: F.round(v * 255).cast("int"))
    df = features(spark, sf_dir).select("doc_id", values.alias("v"))
    return df.select("doc_id", joined(whole).alias("octets"), F.round(arrays.total(F.col("v")), 6).alias("total"))


@query(
    "h5_normalise",
    D + ", " + VALUES + ", n AS (SELECT doc_id, list_transform(v, lambda x: (x / 255.0::DOUBLE - 0.25) / 0.25) AS before, "
    "list_transform(range(0, 1024), lambda i: CASE WHEN i < feature_len THEN (v[i + 1] / 255.0::DOUBLE - 0.5) / 0.5 ELSE 0.0::DOUBLE END) AS after FROM b) "
    f"SELECT doc_id, {rounded_sql('before', 4)} AS before, {rounded_sql('after', 4)} AS after FROM n",
)
def h5(spark, sf_dir):
    x = F.col("x")
    before, after = wide.normalised_arrow(x, 1024, 0.25, 0.25), wide.normalised_arrow(x, 1024, 0.5, 0.5, pad="after")
    return features(spark, sf_dir).select("doc_id", rounded(before, 4).alias("before"), rounded(after, 4).alias("after"))


@query(
    "h6_slice_values",
    D + ", " + VALUES + " SELECT doc_id, array_to_string(v[1:512], ',') AS values FROM b",
)
def h6(spark, sf_dir):
    values = F.slice(wide.byte_values_arrow(octets.crop_and_pad(F.col("x"))), 1, 512)
    return features(spark, sf_dir).select("doc_id", joined(values).alias("values"))


@query(
    "h7_attention_mask",
    D + ", e AS (SELECT doc_id, ceil(least(feature_len, 1024) / 64.0)::INT AS patches FROM d) "
    "SELECT doc_id, patches, rpad(repeat('1', patches), 16, '0') AS mask FROM e",
)
def h7(spark, sf_dir):
    patches = arrays.effective_patches(F.col("feature_len"), 1024, 64)
    mask = arrays.attention_mask(F.col("patches"), 16)
    df = features(spark, sf_dir).select("doc_id", patches.alias("patches"))
    return df.select("doc_id", "patches", F.array_join(mask.cast("array<string>"), "").alias("mask"))


PATCHES = "list_transform(range(0, 16), lambda p: v[p * 64 + 1 : p * 64 + 64])"


@query(
    "h8_patchify",
    D + ", " + VALUES + f", p AS (SELECT doc_id, {PATCHES} AS ps FROM b), q AS (SELECT doc_id, unnest(ps) AS patch, "
    "unnest(range(0, 16))::INT AS pos FROM p) SELECT doc_id, pos, array_to_string(patch, ',') AS patch FROM q",
)
def h8(spark, sf_dir):
    patches = features(spark, sf_dir).select("doc_id", wide.patch_values_arrow(F.col("x"), 64, 16).alias("p"))
    return patches.select("doc_id", F.posexplode("p").alias("pos", "patch")).withColumn("patch", joined(F.col("patch")))


@query("h20_unpatchify", D + ", " + VALUES + " SELECT doc_id, array_to_string(v, ',') AS values FROM b")
def h20(spark, sf_dir):
    patches = features(spark, sf_dir).select("doc_id", wide.patch_values_arrow(F.col("x"), 64, 16).alias("p"))
    return patches.select("doc_id", joined(arrays.unpatchify(F.col("p"))).alias("values"))


@query(
    "h11_random_masking",
    "WITH n AS (SELECT doc_id, unnest(range(0, 16)) AS p FROM documents), "
    "r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws(':', '3', doc_id, p))) - 1 AS place FROM n) "
    "SELECT doc_id, string_agg(p, ',' ORDER BY place) AS ids_shuffle, string_agg(place, ',' ORDER BY p) AS ids_restore, "
    "string_agg(CASE WHEN place < 13 THEN '0' ELSE '1' END, '' ORDER BY p) AS mask FROM r GROUP BY doc_id",
)
def h11(spark, sf_dir):
    shuffle, restore, mask = arrays.masking(3, ["doc_id"], 16, 0.15)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(shuffle.cast("array<string>"), ",").alias("ids_shuffle"),
        F.array_join(restore.cast("array<string>"), ",").alias("ids_restore"),
        F.array_join(mask.cast("array<string>"), "").alias("mask"),
    )


VECTOR_PATCHES = "list_transform(range(0, 8), lambda p: list_transform(embedding[p * 8 + 1 : p * 8 + 8], lambda x: x::DOUBLE))"
SCALED = "list_transform(patch, lambda x: (x - m) / sqrt(s + 1e-6))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(
    "h14_patch_targets",
    f"WITH p AS (SELECT vec_id, unnest({VECTOR_PATCHES}) AS patch, unnest(range(0, 8))::INT AS pos FROM embeddings), "
    "q AS (SELECT vec_id, pos, patch, list_avg(patch) AS m, list_var_samp(patch) AS s FROM p) "
    f"SELECT vec_id, pos, {rounded_sql(SCALED, 5)} AS target FROM q",
)
def h14(spark, sf_dir):
    patches = vectors(spark, sf_dir).select("vec_id", arrays.patchify(F.col("v"), 8, 8).alias("p"))
    targets = patches.select("vec_id", F.posexplode(arrays.patch_targets(F.col("p"))).alias("pos", "t"))
    return targets.select("vec_id", "pos", rounded(F.col("t"), 5).alias("target"))


@query(
    "h15_masked_error",
    "WITH p AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS t, unnest(list_reverse(embedding))::DOUBLE AS y FROM embeddings), "
    "e AS (SELECT vec_id, label, i // 8 AS p, avg((y - t) * (y - t)) AS mse FROM p GROUP BY 1, 2, 3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY md5(concat_ws(':', '3', vec_id, p))) - 1 AS place FROM e) "
    "SELECT label, round(sum(mse) FILTER (place >= 6) / count(*) FILTER (place >= 6), 6) AS loss FROM r GROUP BY label",
)
def h15(spark, sf_dir):
    _, _, mask = arrays.masking(3, ["vec_id"], 8, 0.25)
    v = F.col("v")
    errors = arrays.patch_errors(arrays.patchify(F.reverse(v), 8, 8), arrays.patchify(v, 8, 8))
    df = vectors(spark, sf_dir).select("label", F.explode(F.arrays_zip(errors.alias("e"), mask.alias("m"))).alias("z"))
    loss = F.sum(F.col("z.e") * F.col("z.m")) / F.sum("z.m")
    return df.groupBy("label").agg(F.round(loss, 6).alias("loss"))


@query(
    "h17_token_masking",
    "WITH t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\\s+')) AS token, "
    "unnest(range(0, len(regexp_split_to_array(text, '\\s+')))) AS i, len(regexp_split_to_array(text, '\\s+')) AS n FROM conversations), "
    "m AS (SELECT *, i > 0 AND i < n - 1 AND substr(md5(concat_ws(':', '5', conv_id, turn, i)), 1, 8) < '26666666' AS hit FROM t) "
    "SELECT conv_id, turn, string_agg(CASE WHEN hit THEN '[MASK]' ELSE token END, ' ' ORDER BY i) AS tokens FROM m GROUP BY 1, 2",
)
def h17(spark, sf_dir):
    tokens = F.split("text", r"\s+")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("t"))
    ends = F.transform("t", lambda _, i: (i == 0) | (i == F.size("t") - 1))
    masked = arrays.mask_tokens(F.col("t"), F.col("s"), 5, ["conv_id", "turn"], 0.15, "[MASK]")
    return turns.withColumn("s", ends).select("conv_id", "turn", F.array_join(masked, " ").alias("tokens"))


@query(
    "h18_masked_softmax",
    "WITH s AS (SELECT vec_id, list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE + CASE WHEN i % 4 = 3 THEN -1000.0::DOUBLE ELSE 0.0::DOUBLE END) AS a "
    "FROM embeddings), e AS (SELECT vec_id, list_transform(a, lambda v: exp(v - list_max(a))) AS p FROM s), "
    "w AS (SELECT vec_id, list_transform(p, lambda v: v / list_sum(p)) AS w FROM e) "
    f"SELECT vec_id, {rounded_sql('w')} AS weights FROM w",
)
def h18(spark, sf_dir):
    bias = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 4 == 3, -1000.0).otherwise(0.0))
    return vectors(spark, sf_dir).select("vec_id", rounded(arrays.softmax(F.col("v"), bias)).alias("weights"))


@query(
    "h19_cross_entropy",
    "WITH s AS (SELECT label, list_transform(embedding, lambda v: v::DOUBLE) AS a FROM embeddings) "
    "SELECT label, round(avg(ln(list_sum(list_transform(a, lambda v: exp(v)))) - a[label + 1]), 6) AS loss FROM s GROUP BY label",
)
def h19(spark, sf_dir):
    loss = F.avg(arrays.cross_entropy(F.col("v"), F.col("label")))
    return vectors(spark, sf_dir).groupBy("label").agg(F.round(loss, 6).alias("loss"))


@query(
    "d12_mean_and_deviation",
    D + ", " + VALUES + ", s AS (SELECT doc_id, list_avg(list_transform(v, lambda x: x / 255.0::DOUBLE)) AS m, "
    "list_stddev_samp(list_transform(v, lambda x: x / 255.0::DOUBLE)) AS s FROM b), "
    "u AS (SELECT 'all' AS rows, * FROM s UNION ALL SELECT 'first', * FROM (SELECT * FROM s ORDER BY doc_id LIMIT 101)) "
    "SELECT rows, round(avg(m), 6) AS mean, round(avg(s), 6) AS std, round(sqrt((sum(s * s * 1023) + sum(1024 * m * m) "
    "- sum(1024 * m) * sum(1024 * m) / (count(*) * 1024)) / (count(*) * 1024 - 1)), 6) AS pooled_std FROM u GROUP BY rows",
)
def d12(spark, sf_dir):
    from packetloom.operators.projection import mean_and_deviation

    df = features(spark, sf_dir).select("doc_id", wide.unit_floats_arrow(F.col("x")).alias("v"))
    whole = mean_and_deviation(df, "v").withColumn("rows", F.lit("all"))
    first = mean_and_deviation(df, "v", first=101, order="doc_id").withColumn("rows", F.lit("first"))
    both = whole.unionByName(first)
    return both.select("rows", *[F.round(c, 6).alias(c) for c in ("mean", "std", "pooled_std")])


@query(
    "d20_argmax",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS pred FROM embeddings",
)
def d20(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", arrays.argmax(F.col("v")).alias("pred"))


@query(
    "d1_mask_histogram",
    "WITH n AS (SELECT doc_id, unnest(range(0, 16)) AS p FROM documents), "
    "r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws(':', '3', doc_id, p))) - 1 AS place FROM n) "
    "SELECT p::INT AS p, count(*) AS count FROM r WHERE place >= 13 GROUP BY p",
)
def mask_histogram(spark, sf_dir):
    _, _, mask = arrays.masking(3, ["doc_id"], 16, 0.15)
    docs = table(spark, sf_dir, "documents").select(F.posexplode(mask).alias("p", "m"))
    return value_counts(docs.where("m = 1"), "p")


@query(
    "u_row_hashes",
    "SELECT event_id, md5(concat_ws(':', '1', event_id, user_id)) AS h FROM events",
)
def row_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hash_key(1, "event_id", "user_id").alias("h"))
