"""Label statistics, numbering, mappings and the joins that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.names import class_name, clean_label, clean_stem, directory_label, file_stem
from packetloom.operators import labels, lengths
from packetloom.operators.stored import attach, stored
from queries.registry import features, features_sql, placed, query, table

D = f"WITH d AS ({features_sql()}) "
S = f"WITH d AS ({features_sql('source')}) "

# Labels with mixed case and special characters, made from the source column.
NAMED = F"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '.' || lang AS labels FROM documents) "


def named(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    return docs.select("doc_id", F.concat(source, F.lit("."), "lang").alias("labels"))


@query("d1_label_distribution", D + "SELECT labels, count(*) AS count FROM d GROUP BY 1")
def d1(spark, sf_dir):
    return labels.label_distribution(features(spark, sf_dir))


@query(
    "d1_label_order",
    D + "SELECT labels, count(*) AS count, row_number() OVER (ORDER BY lower(labels), labels) AS position FROM d GROUP BY labels",
)
def d1_order(spark, sf_dir):
    return placed(labels.label_distribution(features(spark, sf_dir)))


@query(
    "d7_frequency_order",
    "SELECT l_partkey, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS position FROM lineitem GROUP BY 1",
)
def d7_order(spark, sf_dir):
    return placed(labels.frequency_table(table(spark, sf_dir, "lineitem"), "l_partkey"))


@query(
    "d1_counts_by_two_columns",
    "SELECT lang, source, count(*) AS count FROM documents GROUP BY 1, 2",
)
def d1b(spark, sf_dir):
    return labels.value_counts(table(spark, sf_dir, "documents"), "lang", "source")


@query(
    "d2_smallest_class",
    D + "SELECT min(n) AS smallest, greatest(min(n), 200) AS cap FROM (SELECT count(*) AS n FROM d GROUP BY labels)",
)
def d2(spark, sf_dir):
    return labels.smallest_class(features(spark, sf_dir), "labels", 200)


@query(
    "d3_dense_histogram",
    "WITH c AS (SELECT (n_chars // 1000)::INT AS class_id, count(*) AS n FROM documents GROUP BY 1) "
    "SELECT g.class_id::INT AS class_id, coalesce(c.n, 0)::BIGINT AS n "
    "FROM (SELECT unnest(range((SELECT max(class_id) FROM c) + 1)) AS class_id) g LEFT JOIN c ON c.class_id = g.class_id",
)
def d3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / 1000).cast("int").alias("class_id"))
    return labels.dense_histogram(docs, "class_id")


@query(
    "d4_long_rows",
    D + "SELECT labels, count(*) FILTER (feature_len >= 1024)::BIGINT AS n_1024, "
    "count(*) FILTER (feature_len >= 500)::BIGINT AS n_500 FROM d GROUP BY labels",
)
def d4(spark, sf_dir):
    return lengths.long_row_counts(features(spark, sf_dir), [1024, 500])


@query(
    "d5_distinct_per_member",
    "SELECT DISTINCT lang AS split, source AS dataset, doc_id % 7 AS value FROM documents",
)
def d5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    members = docs.select(F.col("lang").alias("split"), F.col("source").alias("dataset"), (F.col("doc_id") % 7).alias("value"))
    return labels.distinct_per_member(members, "value")


@query(
    "d6_members_shape",
    "SELECT lang AS split, source AS dataset, count(*) AS num_rows, 2::INT AS num_columns, 'doc_id,text' AS column_names "
    "FROM documents GROUP BY 1, 2",
)
def d6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return labels.members_shape(docs.select(F.col("lang").alias("split"), F.col("source").alias("dataset"), "doc_id", "text"))


@query("d7_frequency_table", "SELECT l_partkey, count(*) AS frequency FROM lineitem GROUP BY 1")
def d7(spark, sf_dir):
    return labels.frequency_table(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    "d24_length_by_label",
    D + "SELECT labels, round(avg(feature_len), 6) AS mean_len, count(*) AS n FROM d GROUP BY labels",
)
def d24(spark, sf_dir):
    return labels.length_by_label(features(spark, sf_dir), "labels", "feature_len").withColumn("mean_len", F.round("mean_len", 6))


@query("g3_distinct_labels", "SELECT DISTINCT source AS labels FROM documents")
def g3(spark, sf_dir):
    return features(spark, sf_dir, "source").select("labels").distinct()


@query(
    "e6_dense_labels",
    "SELECT event_id, (dense_rank() OVER (ORDER BY user_id) - 1)::INT AS user_id FROM events",
)
def e6(spark, sf_dir):
    return labels.dense_labels(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


MAPPING = (
    "m AS (SELECT label, (row_number() OVER (ORDER BY lower(label), label) - 1)::INT AS label_id FROM "
    "(SELECT DISTINCT regexp_replace(labels, '[^0-9a-zA-Z]+', '_', 'g') AS label FROM d WHERE labels IS NOT NULL)) "
)


@query("e7_label_mapping", NAMED + ", " + MAPPING + "SELECT label, label_id FROM m")
def e7(spark, sf_dir):
    return labels.label_mapping(named(spark, sf_dir))


@query(
    "e7_numeric_label_mapping",
    "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id FROM (SELECT DISTINCT p_size AS label FROM part)",
)
def e7b(spark, sf_dir):
    return labels.label_mapping(table(spark, sf_dir, "part"), "p_size")


@query(
    "c6_label_lookup",
    NAMED + ", " + MAPPING + "SELECT doc_id, labels, label_id FROM d LEFT JOIN m "
    "ON m.label = regexp_replace(labels, '[^0-9a-zA-Z]+', '_', 'g')",
)
def c6(spark, sf_dir):
    df = named(spark, sf_dir)
    return labels.with_label_id(df, stored(labels.label_mapping(df), "label-mapping"))


@query(
    "c7_align_labels",
    "SELECT s_suppkey, (100 - n_nationkey)::INT AS s_nationkey FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
)
def c7(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.col("n_nationkey").alias("label_id"), F.upper("n_name").alias("label"))
    target = nation.select(F.lower("n_name").alias("label"), (100 - F.col("n_nationkey")).alias("label_id"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return labels.align_labels(suppliers, names, target, "s_nationkey")


@query(
    "m5_class_codes",
    "WITH v AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 5 > 0 THEN source END, 'None') AS t FROM documents) "
    "SELECT doc_id, (dense_rank() OVER (ORDER BY t) - 1)::INT AS source FROM v",
)
def m5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    some = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"))
    return labels.encode_classes(some, "source", include_nulls=True)[0]


@query(
    "m5_class_codes_with_nulls",
    "WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS t FROM documents) "
    "SELECT v.doc_id, c.id AS source FROM v LEFT JOIN (SELECT t, (row_number() OVER (ORDER BY t) - 1)::INT AS id "
    "FROM (SELECT DISTINCT t FROM v WHERE t IS NOT NULL)) c ON c.t = v.t",
)
def m5b(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    some = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"))
    return labels.encode_classes(some, "source")[0]


@query(
    "b1_labelled_rows",
    D + "SELECT doc_id, labels, feature_len FROM d WHERE labels IS NOT NULL AND feature_len > 0",
)
def b1(spark, sf_dir):
    return lengths.labelled_rows(features(spark, sf_dir)).select("doc_id", "labels", "feature_len")


@query(
    "b16_label_membership",
    "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')",
)
def b16(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query(
    "b19_class_names",
    "SELECT page_id, regexp_extract(f, '^(.*)\\.pcap', 1) AS class FROM "
    "(SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || '.pcap.transformed' AS f FROM pages)",
)
def b19(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.regexp_extract("url", "([^/]*)$", 1), F.lit(".pcap.transformed"))
    named_pages = pages.select("page_id", class_name(name).alias("class"))
    return named_pages.orderBy(F.lower("class"), "class", "page_id")


@query(
    "h9_clean_labels",
    "SELECT page_id, regexp_replace(url, '[^0-9a-zA-Z]+', '_', 'g') AS label FROM pages",
)
def h9(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_label(F.col("url")).alias("label"))


@query(
    "h10_clean_stems",
    "SELECT doc_id, regexp_replace(text, '[^._\\p{L}\\p{N}]+', '_', 'g') AS stem FROM documents",
)
def h10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean_stem(F.col("text")).alias("stem"))


@query(
    "h21_folded_labels",
    NAMED + "SELECT doc_id, lower(labels) AS folded, least(lower(labels), labels) AS low, "
    "greatest(lower(labels), labels) AS high FROM d",
)
def h21(spark, sf_dir):
    lower = F.lower("labels")
    return named(spark, sf_dir).select(
        "doc_id", lower.alias("folded"), F.least(lower, "labels").alias("low"), F.greatest(lower, "labels").alias("high")
    )


@query(
    "h22_conditional_values",
    "SELECT o_orderkey, least(o_totalprice, 100000.0::DOUBLE, CASE WHEN o_orderstatus = 'F' THEN 50000.0::DOUBLE END) AS low, "
    "greatest(o_totalprice, 100000.0::DOUBLE, CASE WHEN o_orderstatus = 'F' THEN 500000.0::DOUBLE END) AS high, "
    "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INT AS status_id FROM orders",
)
def h22(spark, sf_dir):
    codes = F.create_map(F.lit("F"), F.lit(0), F.lit("O"), F.lit(1))
    finished = F.col("o_orderstatus") == "F"
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.least(price, F.lit(100000.0), F.when(finished, 50000.0)).alias("low"),
        F.greatest(price, F.lit(100000.0), F.when(finished, 500000.0)).alias("high"),
        codes[F.col("o_orderstatus")].alias("status_id"),
    )


@query(
    "c1_attach_label_count",
    D + "SELECT doc_id, d.labels, c.label_count FROM d JOIN (SELECT labels, count(*) AS label_count FROM d GROUP BY 1) c "
    "ON c.labels = d.labels",
)
def c1(spark, sf_dir):
    return labels.with_label_count(features(spark, sf_dir), "labels").select("doc_id", "labels", "label_count")


@query(
    "c2_left_join_flag",
    "SELECT d.doc_id, (l.doc_id IS NOT NULL) AS covered FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def c2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    known = table(spark, sf_dir, "labels").select("doc_id").withColumn("flag", F.lit(True))
    return docs.join(known, "doc_id", "left").select("doc_id", F.col("flag").isNotNull().alias("covered"))


CANDIDATES = [1024, 700, 600, 500, 400, 140, 50]
COUNTS = ", ".join(f"count(*) FILTER (feature_len >= {n}) AS n_{n}" for n in CANDIDATES)
CHOICE = " ".join(f"WHEN n_{n} >= 40 THEN {n}" for n in CANDIDATES)


@query(
    "c3_attach_chosen_length",
    S + f", c AS (SELECT labels, CASE {CHOICE} END::INT AS chosen_len FROM (SELECT labels, {COUNTS} FROM d GROUP BY 1)) "
    "SELECT doc_id, d.labels, feature_len, chosen_len FROM d JOIN c ON c.labels = d.labels AND feature_len >= chosen_len",
)
def c3(spark, sf_dir):
    df = features(spark, sf_dir, "source").drop("x")
    chosen = stored(lengths.chosen_lengths(df, CANDIDATES, 40), "chosen-lengths")
    return attach(df, chosen, ["labels"], null_keys=False).where(F.col("feature_len") >= F.col("chosen_len"))


@query(
    "c4_lost_labels",
    "WITH o AS (SELECT (n_chars // 50)::BIGINT AS labels, octet_length(encode(text)) AS feature_len FROM documents) "
    "SELECT labels, count(*) AS original_count FROM o GROUP BY labels HAVING max(feature_len) < 2000",
)
def c4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    o = docs.select(F.floor(F.col("n_chars") / 50).alias("labels"), F.octet_length(F.encode("text", "utf-8")).alias("feature_len"))
    return lengths.lost_labels(o, o.where(F.col("feature_len") >= 2000))


@query(
    "c8_keep_passing_units",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN "
    "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 120)",
)
def c8(spark, sf_dir):
    from packetloom.operators.flows import semi_units

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    units = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q >= 120")
    return semi_units(lines, stored(units.select("l_orderkey"), "units"), ["l_orderkey"])


TWO_TIER = (
    "SELECT doc_id, labels, feature_len FROM (SELECT *, count(*) FILTER (feature_len >= 1024) OVER (PARTITION BY labels) AS c FROM d) "
    "WHERE (c >= 100 AND feature_len >= 1024) OR (c < 100 AND feature_len >= 120)"
)


@query("e4_two_tier_length", D + TWO_TIER)
def e4(spark, sf_dir):
    return lengths.filter_two_tier(features(spark, sf_dir), threshold=100).select("doc_id", "labels", "feature_len")


@query(
    "e5_adaptive_length",
    S + f", c AS (SELECT labels, CASE {CHOICE} END AS m FROM (SELECT labels, {COUNTS} FROM d GROUP BY 1)) "
    "SELECT doc_id, d.labels, feature_len FROM d JOIN c ON c.labels = d.labels WHERE feature_len >= m",
)
def e5(spark, sf_dir):
    df = features(spark, sf_dir, "source")
    return lengths.filter_adaptive(df, CANDIDATES, 40).select("doc_id", "labels", "feature_len")


@query(
    "e5_adaptive_length_literal",
    D + "SELECT doc_id, labels, feature_len FROM (SELECT *, count(*) FILTER (feature_len >= 1024) OVER (PARTITION BY labels) AS c "
    "FROM d) WHERE c >= 100 AND feature_len >= 1024",
)
def e5b(spark, sf_dir):
    df = features(spark, sf_dir)
    return lengths.filter_adaptive(df, CANDIDATES, 100, literal=True).select("doc_id", "labels", "feature_len")


@query(
    "a2_labels_from_paths",
    "SELECT label, (row_number() OVER (ORDER BY lower(label), label) - 1)::INT AS label_id FROM "
    "(SELECT DISTINCT regexp_extract(url, '([^/]+)/[^/]+$', 1) AS label FROM pages)",
)
def a2(spark, sf_dir):
    from packetloom.sources.files import directory_ids

    return directory_ids(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query(
    "a3_grouped_files",
    "WITH p AS (SELECT regexp_replace(url, '^https?:/', '') AS path, octet_length(encode(html))::BIGINT AS length FROM pages "
    "WHERE octet_length(encode(html)) > 1000), "
    "q AS (SELECT path, length, regexp_replace(regexp_replace(path, '/[^/]*$', ''), '^/+', '') AS split, "
    "regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[^._\\p{L}\\p{N}]+', '_', 'g') "
    "AS dataset FROM p) "
    "SELECT split, dataset, path, length, count(*) OVER (PARTITION BY split, dataset) > 1 AS duplicate FROM q",
)
def a3(spark, sf_dir):
    from packetloom.sources.files import group_files

    pages = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^https?:/", "")
    listing = pages.select(path.alias("path"), F.octet_length(F.encode("html", "utf-8")).cast("long").alias("length"))
    return group_files(listing, "/", 1000)


@query(
    "a13_file_stats",
    "SELECT l_returnflag, count(*) AS num_rows, count(DISTINCT l_orderkey) AS num_streams FROM lineitem GROUP BY 1",
)
def a13(spark, sf_dir):
    stats = labels.file_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey")
    return stats
