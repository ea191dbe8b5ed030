"""Sources and sinks: every table written in a format and read back, and two-level datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.octets import hex_text
from packetloom.operators.members import Members, flatten_structs
from packetloom.operators.sampling import split_exact
from packetloom.operators.stored import new_path
from packetloom.sources import tables
from queries.registry import PACKETS_SQL, features, features_sql, packets, query, table

D = f"WITH d AS ({features_sql()}) "


@query(
    "a5_csv_scan",
    "SELECT turn + 1 AS frame_number, (turn * 0.5)::DOUBLE AS frame_time_relative, conv_id AS tcp_stream, '10.0.0.1' AS ip_src, 443 AS tcp_srcport, "
    "'10.0.0.2' AS ip_dst, 80 AS tcp_dstport, (octet_length(encode(text)) + 54)::BIGINT AS frame_len, (octet_length(encode(text)) + 40)::BIGINT AS ip_len, "
    "lower(hex(encode(text))) AS tcp_payload FROM conversations",
)
def a5(spark, sf_dir):
    size = F.octet_length(F.encode("text", "utf-8"))
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("turn") + 1).alias("frame.number"),
        (F.col("turn") * 0.5).alias("frame.time_relative"),
        F.col("conv_id").alias("tcp.stream"),
        F.lit("10.0.0.1").alias("ip.src"),
        F.lit(443).alias("tcp.srcport"),
        F.lit("10.0.0.2").alias("ip.dst"),
        F.lit(80).alias("tcp.dstport"),
        (size + 54).alias("frame.len"),
        (size + 40).alias("ip.len"),
        F.lower(F.hex(F.encode("text", "utf-8"))).alias("tcp.payload"),
    )
    path = new_path(spark, "fields-csv")
    rows.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, tables.field_extract_schema("tcp"))


@query(
    "a6_tsv_templates",
    "SELECT doc_id % 10 AS label_id, lower(hex(encode(text))) AS packet FROM documents",
)
def a6(spark, sf_dir):
    path = new_path(spark, "templates-tsv")
    text = hex_text(F.encode("text", "utf-8"))
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("label"), text.alias("text_a"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_templates(spark, path).withColumn("packet", hex_text("packet"))


@query(
    "a7_json_features",
    "SELECT label::BIGINT AS label, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) AS total, len(embedding)::BIGINT AS feature_len FROM embeddings",
)
def a7(spark, sf_dir):
    path = new_path(spark, "features-json")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("feature"), F.size("embedding").alias("feature_len")
    )
    rows.write.option("compression", "gzip").json(path)
    read = tables.read_json(spark, path, tables.OLD_FEATURE_SCHEMA)
    total = F.aggregate("feature", F.lit(0.0), lambda acc, v: acc + v)
    return read.select("label", F.round(total, 6).alias("total"), "feature_len")


@query("a8_parquet_columns", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def a8(spark, sf_dir):
    read = tables.read_parquet(spark, f"{sf_dir}/order*.parquet", columns=["o_orderkey", "o_totalprice"])
    return read.where(F.col("o_totalprice") > 200000)


@query(
    "a9_text_lines",
    "SELECT unnest(string_split(replace(replace(text, chr(13), ''), chr(11), ' '), chr(10))) AS value FROM documents",
)
def a9(spark, sf_dir):
    path = new_path(spark, "texts")
    text = F.regexp_replace(F.regexp_replace("text", "\r", ""), "\u000b", " ")
    table(spark, sf_dir, "documents").select(text.alias("value")).write.text(path)
    return tables.read_text(spark, path)


@query("a10_append_features", D + "SELECT doc_id, hx AS x, feature_len, labels FROM d UNION ALL SELECT doc_id, hx, feature_len, labels FROM d WHERE labels = 'de'")
def a10(spark, sf_dir):
    path = new_path(spark, "features")
    df = features(spark, sf_dir)
    tables.write_parquet(df, path, compression="gzip")
    tables.write_parquet(df.where("labels = 'de'"), path, mode="append", compression="gzip")
    return tables.read_parquet(spark, path, df.schema).withColumn("x", hex_text("x"))


@query(
    "a11_train_test_files",
    D + "SELECT doc_id, labels FROM (SELECT *, row_number() OVER (PARTITION BY labels ORDER BY md5(concat_ws(':', '4711', doc_id))) AS rn, "
    "count(*) OVER (PARTITION BY labels) AS c FROM d WHERE labels IS NOT NULL) WHERE rn <= c * 0.2::DOUBLE",
)
def a11(spark, sf_dir):
    path = new_path(spark, "train-test")
    tables.write_parts(split_exact(features(spark, sf_dir).select("doc_id", "labels"), ["doc_id"], 0.2), path)
    return tables.read_part(spark, path, "test")


@query(
    "a11_both_files",
    D + "SELECT doc_id, labels, CASE WHEN rn <= c * 0.2::DOUBLE THEN 'test' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER "
    "(PARTITION BY labels ORDER BY md5(concat_ws(':', '4711', doc_id))) AS rn, count(*) OVER (PARTITION BY labels) AS c FROM d WHERE labels IS NOT NULL)",
)
def a11b(spark, sf_dir):
    path = new_path(spark, "train-test")
    tables.write_parts(split_exact(features(spark, sf_dir).select("doc_id", "labels"), ["doc_id"], 0.2), path)
    sides = [tables.read_part(spark, path, part).select("doc_id", "labels", F.lit(part).alias("part")) for part in ("train", "test")]
    return sides[0].unionByName(sides[1])


MEMBERS_SQL = "SELECT lang AS split, source AS dataset, doc_id, n_chars FROM documents"


def members(spark, sf_dir) -> Members:
    docs = table(spark, sf_dir, "documents")
    return Members(docs.select(F.col("lang").alias("split"), F.col("source").alias("dataset"), "doc_id", "n_chars"))


@query("a12_saved_members", MEMBERS_SQL)
def a12(spark, sf_dir):
    path = new_path(spark, "members")
    members(spark, sf_dir).save(path)
    return Members.load(spark, path).df.select("split", "dataset", "doc_id", "n_chars")


@query("a12_member_files", "SELECT 'split=' || lang AS split, doc_id, n_chars FROM documents")
def a12b(spark, sf_dir):
    path = new_path(spark, "member-files")
    members(spark, sf_dir).df.write.partitionBy("split").parquet(path)
    schema = "doc_id long, n_chars long"
    return Members.from_parquet(spark, path, schema).df.drop("dataset")


@query(
    "a13_side_tables",
    D + "SELECT label, label_id, count(*) OVER () AS classes FROM (SELECT labels AS label, row_number() OVER (ORDER BY lower(labels), labels) - 1 AS label_id "
    "FROM (SELECT DISTINCT labels FROM d))",
)
def a13(spark, sf_dir):
    from packetloom.operators.labels import label_mapping

    path = new_path(spark, "label-mapping")
    tables.write_side_table(label_mapping(features(spark, sf_dir)), path)
    read = tables.read_json(spark, path, "label string, label_id long")
    return read.withColumn("classes", F.lit(tables.label_count(read)).cast("long"))


@query("a14_burst_rows", "SELECT lower(hex(encode(text))) AS burst, octet_length(encode(text))::INT AS len, (doc_id % 10)::INT AS label FROM documents")
def a14(spark, sf_dir):
    path = new_path(spark, "bursts")
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("label_id"), F.encode("text", "utf-8").alias("packet"))
    tables.write_parquet(tables.burst_rows(rows), path)
    return tables.read_parquet(spark, path, tables.BURST_SCHEMA).withColumn("burst", hex_text("burst"))


@query(
    "b13_columns",
    "SELECT lang AS split, source AS dataset, doc_id::VARCHAR AS id FROM documents",
)
def b13(spark, sf_dir):
    return members(spark, sf_dir).remove_columns("n_chars").cast_column("doc_id", "string").rename_column("doc_id", "id").df


@query("b14_row_filter", MEMBERS_SQL + " WHERE n_chars > 1000 AND source > 'm'")
def b14(spark, sf_dir):
    return members(spark, sf_dir).filter(F.col("n_chars") > 1000).filter(lambda batch: batch["dataset"] > "m").df


INDEXED = "row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1"


@query(
    "b14_row_filter_by_index",
    f"SELECT split, dataset, doc_id, n_chars FROM (SELECT lang AS split, source AS dataset, doc_id, n_chars, {INDEXED} AS i FROM documents) "
    "WHERE i % 3 = 1 AND n_chars > 200",
)
def b14b(spark, sf_dir):
    return members(spark, sf_dir).filter(lambda b: (b["index"] % 3 == 1) & (b["n_chars"] > 200), ["doc_id"], ["n_chars"]).df


@query("b17_restricted_columns", "SELECT lang AS split, source AS dataset, n_chars FROM documents")
def b17(spark, sf_dir):
    return members(spark, sf_dir).select_columns(["n_chars"]).df


@query("b18_lazy_transform", "SELECT lang AS split, source AS dataset, doc_id, n_chars, n_chars * 2 AS twice FROM documents")
def b18(spark, sf_dir):
    return members(spark, sf_dir).transform(lambda df: df.withColumn("twice", F.col("n_chars") * 2)).df


@query(
    "g1_merged_rows",
    "SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT page_id, html FROM pages",
)
def g1(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "pages")
    bench = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    renamed = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return docs.unionByName(bench).unionByName(renamed)


@query("g2_members_as_paths", "SELECT lang || '/' || source AS path, count(*) AS n FROM documents GROUP BY 1")
def g2(spark, sf_dir):
    return members(spark, sf_dir).as_paths().groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("g2_members_as_splits", "SELECT lang AS split, doc_id, n_chars FROM documents")
def g2b(spark, sf_dir):
    return members(spark, sf_dir).as_splits()


@query("m1_mapped_batches", MEMBERS_SQL.replace("n_chars FROM", "n_chars % 97 AS n_chars FROM"))
def m1(spark, sf_dir):
    return members(spark, sf_dir).map(lambda b: b[["n_chars"]] % 97, "n_chars long", ["n_chars"], batch_size=100).df


@query(
    "m1_mapped_with_indices",
    f"SELECT lang AS split, source AS dataset, doc_id, n_chars, n_chars * 1000 + ({INDEXED}) AS code FROM documents",
)
def m1b(spark, sf_dir):
    def code(batch):
        return (batch["n_chars"] * 1000 + batch["index"]).to_frame("code")

    return members(spark, sf_dir).map(code, "code long", ["n_chars"], with_indices=["doc_id"]).df


@query(
    "m2_mapped_members",
    f"WITH p AS ({PACKETS_SQL}) SELECT 'all' AS split, file AS dataset, stream, sum(length(payload))::BIGINT AS digits FROM p GROUP BY 2, 3",
)
def m2(spark, sf_dir):
    import pandas as pd

    df = packets(spark, sf_dir).withColumns({"split": F.lit("all"), "dataset": F.col("file")}).drop("file")

    def size(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stream": [group["stream"].iloc[0]], "digits": [group["payload"].str.len().sum()]})

    return Members(df).map_members(size, "stream long, digits long", by=["stream"]).df


@query("m3_one_split", MEMBERS_SQL + " WHERE lang = 'fr'")
def m3(spark, sf_dir):
    return members(spark, sf_dir)["fr"].df


@query(
    "m4_flattened_structs",
    "SELECT l_orderkey, l_linenumber, l_quantity AS \"a.q\", l_discount AS \"a.b.d\", l_tax AS \"a.b.t\" FROM lineitem",
)
def m4(spark, sf_dir):
    inner = F.struct(F.col("l_discount").alias("d"), F.col("l_tax").alias("t")).alias("b")
    lines = table(spark, sf_dir, "lineitem")
    return flatten_structs(lines.select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("q"), inner).alias("a")))


@query("m6_task_columns", "SELECT lang AS split, source AS dataset, lower(hex(encode(text))) AS pixel_values, lang AS labels FROM documents")
def m6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("split"), F.col("source").alias("dataset"), hex_text(F.encode("text", "utf-8")).alias("x"), F.col("lang").alias("labels"), "n_chars"
    )
    return Members(docs).prepare_for_task("classification").df
