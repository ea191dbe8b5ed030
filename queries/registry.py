"""Where queries and their SQL checks are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ranking import numbered
from packetloom.operators.stored import stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """An ordered result with ``position``, from 1, as it comes."""
    marked = df.withColumn("_mark", F.monotonically_increasing_id())
    return numbered(stored(marked, "ordered"), [F.col("_mark").asc()], "position").drop("_mark")


def features(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """Documents as feature rows: ``doc_id, x, feature_len, labels``."""
    x = F.encode("text", "utf-8")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", x.alias("x"), F.octet_length(x).cast("long").alias("feature_len"), F.col(label).alias("labels"))


def features_sql(label: str = "lang") -> str:
    return (
        f"SELECT doc_id, lower(hex(encode(text))) AS hx, octet_length(encode(text))::BIGINT AS feature_len, "
        f"{label} AS labels FROM documents"
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as packets: ``file, stream, frame_no, protocol, payload``."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat(F.lit("f"), F.col("conv_id") % 3).alias("file"),
        F.col("conv_id").alias("stream"),
        (F.col("turn") + 1).alias("frame_no"),
        F.when(F.col("role") == "user", "TCP").when(F.col("role") == "assistant", "UDP").otherwise("ICMP").alias("protocol"),
        F.lower(F.hex(F.encode("text", "utf-8"))).alias("payload"),
    )


PACKETS_SQL = (
    "SELECT 'f' || (conv_id % 3) AS file, conv_id AS stream, turn + 1 AS frame_no, "
    "CASE role WHEN 'user' THEN 'TCP' WHEN 'assistant' THEN 'UDP' ELSE 'ICMP' END AS protocol, "
    "lower(hex(encode(text))) AS payload FROM conversations"
)
