"""Captures to labelled feature rows, and field extracts to flow samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import flows, packets
from packetloom.operators.members import Members
from packetloom.operators.sampling import sample_flows
from packetloom.operators.stored import attach, stored
from packetloom.sources.captures import BATCH_PACKETS, read_captures
from packetloom.sources.tables import field_extract_schema, write_parquet


def captures_to_features(
    spark: SparkSession,
    root: str,
    target: str,
    batch: int = BATCH_PACKETS,
    max_batches: int | None = None,
    **features: object,
) -> None:
    """Parse, clean, mask and cut all packets below ``root``, or the first ``max_batches`` batches of every file."""
    rows = packets.feature_rows(read_captures(spark, root, batch=batch, max_batches=max_batches), **features)
    write_parquet(rows, target, mode="append")


def packets_to_fields(frames: DataFrame) -> DataFrame:
    """Field-extract rows of IPv4 packets with payload, with stream number and relative time.

    Streams are numbered over all packets of a file, TCP and UDP apart, each from 0.

    The packets are read once for the stream numbers, once for the start of every file and once for
    the rows themselves: pass a packet table, or a scan of captures if parsing is cheap.
    """
    fields = packets.extracted_fields(packets.dissect(frames))
    ends = flows.session_key("ip_src", "sport", "ip_dst", "dport")
    first = stored(frames.groupBy("file_path").agg(F.min("ts").alias("_first")), "first-packet")
    relative = (F.unix_micros("ts") - F.unix_micros("_first")) / F.lit(1_000_000.0)
    timed = attach(fields, first, ["file_path"]).withColumn("time_relative", relative).drop("_first")
    keyed = timed.select("*", *ends)
    return numbered_fields(keyed).drop("host_a", "port_a", "host_b", "port_b")


def numbered_fields(keyed: DataFrame) -> DataFrame:
    """Fields with session keys: ``stream`` numbered per file and protocol, then IPv4 packets with payload kept."""
    numbered = flows.with_streams(keyed, ["file_path", "protocol"], ["host_a", "port_a", "host_b", "port_b"])
    return numbered.where(F.col("ip_src").contains(".") & (F.length("payload") > 0))


def extracts_to_flows(
    spark: SparkSession, root: str, target: str, protocol: str = "tcp", share: int | None = None, threshold: int = 0
) -> Members:
    """Field-extract CSV files below ``root`` to a saved two-level dataset of flow payloads.

    ``share`` keeps one in so many flows of a file, ``threshold`` skips files of so many bytes or fewer.
    """
    rows = Members.from_csv(
        spark, root, field_extract_schema(protocol), pattern=f"*{protocol.upper()}.csv", threshold=threshold
    )
    stream, payload = f"{protocol}_stream", f"{protocol}_payload"
    df = rows.df.withColumn("_file", F.concat_ws("/", "split", "dataset"))
    if share:
        df = sample_flows(df, "_file", stream, share)
    made = flows.assembled(df, ["split", "dataset", stream], "frame_number", payload)
    Members(made).save(target)
    return Members.load(spark, target)
