"""Sampling and splitting; every choice is a hash order that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.hashing import bernoulli, hash_key
from packetloom.operators import ranking, sampling
from packetloom.plans.train_test import prepare
from queries.registry import PACKETS_SQL, features, features_sql, placed, query, table

LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship", "cents"]


def lines(spark, sf_dir):
    """Line items with the columns that identify a row."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.date_format("l_shipdate", "yyyyMMdd").alias("ship"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        "l_returnflag",
    )


def ranked(seed: int, base: str, key: str = "labels", ids: str = "doc_id") -> str:
    order = f"md5(concat_ws(':', '{seed}', {ids}))"
    return (
        f"r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn, "
        f"count(*) OVER (PARTITION BY {key}) AS c FROM {base} WHERE {key} IS NOT NULL)"
    )


D = f"WITH d AS ({features_sql()}), "
S = f"WITH d AS ({features_sql('source')}), "
LINES = (
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d') AS ship, "
    "round(l_extendedprice * 100)::BIGINT AS cents, l_returnflag FROM lineitem), "
)
LINE_IDS = ", ".join(LINE_ID)


@query("e1_under_sample", D + ranked(9876, "d") + " SELECT doc_id, labels FROM r WHERE rn <= 100")
def e1(spark, sf_dir):
    return sampling.under_sample(features(spark, sf_dir), ["doc_id"], 100).select("doc_id", "labels")


@query(
    "e1_under_sample_skewed",
    LINES + ranked(9876, "l", "l_returnflag", LINE_IDS) + f" SELECT {LINE_IDS}, l_returnflag FROM r WHERE rn <= 2000",
)
def e1b(spark, sf_dir):
    return sampling.under_sample(lines(spark, sf_dir), LINE_ID, 2000, "l_returnflag")


@query(
    "e2_exact_split",
    D + ranked(4711, "d") + " SELECT doc_id, labels, CASE WHEN rn <= c * 0.2::DOUBLE THEN 'test' ELSE 'train' END AS part FROM r",
)
def e2(spark, sf_dir):
    return sampling.split_exact(features(spark, sf_dir), ["doc_id"], 0.2).select("doc_id", "labels", "part")


@query(
    "e2_exact_split_lines",
    LINES + ranked(4711, "l", "l_returnflag", LINE_IDS)
    + " SELECT l_returnflag, CASE WHEN rn <= c * 0.1::DOUBLE THEN 'test' ELSE 'train' END AS part, count(*) AS n, "
    "sum(cents)::BIGINT AS cents FROM r GROUP BY 1, 2",
)
def e2b(spark, sf_dir):
    parts = sampling.split_exact(lines(spark, sf_dir), LINE_ID, 0.1, "l_returnflag")
    return parts.groupBy("l_returnflag", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(
    "e3_sample_and_split",
    D + ranked(4711, "d") + " SELECT doc_id, labels, CASE WHEN rn <= floor(least(c, 120) * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS part "
    "FROM r WHERE rn <= least(c, 120)",
)
def e3(spark, sf_dir):
    parts = sampling.sample_and_split(features(spark, sf_dir), ["doc_id"], 120, 0.25)
    return parts.select("doc_id", "labels", "part")


@query(
    "f1_balance_and_split",
    D + ranked(9876, "d") + ", m AS (SELECT greatest(min(c), 110) AS cap FROM r) "
    "SELECT doc_id, labels, CASE WHEN substr(md5(concat_ws(':', '4711', doc_id)), 1, 8) < '33333333' THEN 'test' ELSE 'train' END "
    "AS part FROM r WHERE rn <= (SELECT cap FROM m)",
)
def f1(spark, sf_dir):
    parts = sampling.balance_and_split(features(spark, sf_dir), ["doc_id"], 0.2, "labels", floor=110)
    return parts.select("doc_id", "labels", "part")


@query(
    "f2_sample_share",
    LINES + "r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '9876', " + LINE_IDS + "))) AS rn, count(*) OVER () AS c FROM l) "
    f"SELECT {LINE_IDS} FROM r WHERE rn <= ceil(c * 0.05::DOUBLE)",
)
def f2(spark, sf_dir):
    return sampling.sample_share(lines(spark, sf_dir).drop("l_returnflag"), LINE_ID, 0.05)


@query(
    "f3_sample_flows",
    f"WITH p AS ({PACKETS_SQL}), s AS (SELECT DISTINCT file, stream FROM p), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY md5(concat_ws(':', '9876', file, stream))) AS rn, "
    "count(*) OVER (PARTITION BY file) AS c FROM s) "
    "SELECT p.file, p.stream, p.frame_no FROM p JOIN r ON r.file = p.file AND r.stream = p.stream WHERE rn <= c // 4",
)
def f3(spark, sf_dir):
    from queries.registry import packets

    return sampling.sample_flows(packets(spark, sf_dir), "file", "stream", 4).select("file", "stream", "frame_no")


@query(
    "f4_with_replacement",
    D + ranked(9876, "d") + ", t AS (SELECT labels, max(c) AS c FROM r GROUP BY 1), "
    "w AS (SELECT labels, c, unnest(range(1, 51))::INT AS draw FROM t), "
    "x AS (SELECT labels, draw, ('0x' || substr(md5(concat_ws(':', '9876', labels, draw)), 1, 15))::BIGINT % c + 1 AS rn FROM w) "
    "SELECT r.doc_id, r.labels, x.draw FROM x JOIN r ON r.labels = x.labels AND r.rn = x.rn",
)
def f4(spark, sf_dir):
    draws = sampling.sample_with_replacement(features(spark, sf_dir), ["doc_id"], 50, "labels")
    return draws.select("doc_id", "labels", "draw")


@query(
    "f5_proportional_split",
    S + ranked(4711, "d")
    + ", t AS (SELECT labels, max(c)::HUGEINT AS c FROM r GROUP BY 1), "
    "w AS (SELECT ceil(sum(c)::DOUBLE * 0.33::DOUBLE)::HUGEINT AS want, sum(c)::HUGEINT AS n FROM t), "
    "q AS (SELECT labels, c * want // n AS base, row_number() OVER (ORDER BY (c * want) % n DESC, labels) AS place, want FROM t, w), "
    "a AS (SELECT labels, base + CASE WHEN place <= want - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM q) "
    "SELECT doc_id, r.labels, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS part FROM r JOIN a ON a.labels = r.labels",
)
def f5(spark, sf_dir):
    parts = sampling.split_proportional(features(spark, sf_dir, "source"), ["doc_id"], 0.33, "labels")
    return parts.select("doc_id", "labels", "part")


@query(
    "f5_missing_classes",
    "WITH d AS (SELECT doc_id, n_chars // 500 AS labels FROM documents), "
    + ranked(4711, "d")
    + " SELECT labels, count(*) FILTER (rn > c * 0.2::DOUBLE)::BIGINT AS n_train, count(*) FILTER (rn <= c * 0.2::DOUBLE)::BIGINT AS n_test "
    "FROM r GROUP BY labels HAVING count(*) FILTER (rn <= c * 0.2::DOUBLE) = 0 OR count(*) FILTER (rn > c * 0.2::DOUBLE) = 0",
)
def f5b(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 500).alias("labels"))
    return sampling.missing_classes(sampling.split_exact(docs, ["doc_id"], 0.2), "labels")


RATIOS = [0.1, 0.3, 0.5, 0.7, 0.9]


@query(
    "f6_few_shot_ratios",
    D + ranked(4711, "d") + ", q AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS ratio) "
    "SELECT doc_id, labels, ratio, CASE WHEN rn <= floor(least(c, 140) * ratio) THEN 'test' ELSE 'train' END AS part "
    "FROM r, q WHERE rn <= 140",
)
def f6(spark, sf_dir):
    parts = sampling.split_ratios(features(spark, sf_dir), ["doc_id"], 140, RATIOS)
    return parts.select("doc_id", "labels", "ratio", "part")


@query(
    "f7_shuffle_positions",
    LINES + f"x AS (SELECT 1) SELECT {LINE_IDS}, row_number() OVER (ORDER BY md5(concat_ws(':', '7', {LINE_IDS}))) AS position FROM l",
)
def f7(spark, sf_dir):
    return sampling.shuffle_rank(lines(spark, sf_dir).drop("l_returnflag"), LINE_ID, 7)


@query(
    "f8_sorted_order",
    "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS position FROM customer",
)
def f8_order(spark, sf_dir):
    unique = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.struct(F.col("c_acctbal"), (-F.col("c_custkey")).alias("k")).alias("o"))
    return placed(sampling.sorted_by(unique, "o", reverse=True)).drop("o")


@query("f8_sorted", "SELECT c_custkey, c_acctbal FROM customer")
def f8(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sampling.sorted_by(customers, "c_acctbal", reverse=True, nulls="first")


@query(
    "f9_capped_rows",
    "SELECT event_id, user_id FROM events ORDER BY md5(concat_ws(':', '9876', event_id)) LIMIT 500",
)
def f9(spark, sf_dir):
    return sampling.sample_rows(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"], 500)


@query(
    "f10_validation_split",
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN lang END AS labels, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 <> 0 THEN 'train' ELSE 'extra' END AS split, source AS dataset FROM documents), "
    "t AS (SELECT * FROM d WHERE split = 'train' AND labels IS NOT NULL), "
    + ranked(4711, "t")
    + " SELECT doc_id, labels, CASE WHEN rn <= c * 0.2::DOUBLE THEN 'validation' ELSE 'train' END AS split, dataset FROM r "
    "UNION ALL SELECT doc_id, labels, split, dataset FROM d WHERE split IS NULL OR split = 'extra' OR labels IS NULL",
)
def f10(spark, sf_dir):
    from packetloom.operators.members import Members

    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("labels"),
        F.when(F.col("doc_id") % 13 != 0, F.when(F.col("doc_id") % 7 != 0, "train").otherwise("extra")).alias("split"),
        F.col("source").alias("dataset"),
    )
    return Members(docs).with_validation(["doc_id"], 0.2, "labels", name="validation").df.select(*docs.columns)


@query(
    "f11_train_test_sets",
    D + "k AS (SELECT * FROM (SELECT *, count(*) FILTER (feature_len >= 1024) OVER (PARTITION BY labels) AS n FROM d "
    "WHERE labels IS NOT NULL AND feature_len > 0) WHERE (n >= 100 AND feature_len >= 1024) OR (n < 100 AND feature_len >= 120)), "
    + ranked(9876, "k")
    + " SELECT doc_id, labels, feature_len, CASE WHEN rn <= least(c, 90) * 0.2::DOUBLE THEN 'test' ELSE 'train' END AS part "
    "FROM r WHERE rn <= 90",
)
def f11(spark, sf_dir):
    made = prepare(features(spark, sf_dir), ["doc_id"], 1024, 90, 0.2, threshold=100)
    return made.select("doc_id", "labels", "feature_len", "part")


@query(
    "u_bernoulli_share",
    LINES + f"x AS (SELECT 1) SELECT {LINE_IDS} FROM l WHERE substr(md5(concat_ws(':', '11', {LINE_IDS})), 1, 8) < '20000000'",
)
def bernoulli_share(spark, sf_dir):
    df = lines(spark, sf_dir).drop("l_returnflag")
    return df.where(bernoulli(hash_key(11, *LINE_ID), 0.125))


@query(
    "u_hash_rank",
    LINES + ranked(5, "l", "l_returnflag", LINE_IDS) + f" SELECT {LINE_IDS}, l_returnflag, rn AS rank FROM r",
)
def rank_in_class(spark, sf_dir):
    return ranking.hash_rank(lines(spark, sf_dir), ["l_returnflag"], hash_key(5, *LINE_ID))
