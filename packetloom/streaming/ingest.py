"""Captures to feature rows as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.packets import feature_rows
from packetloom.sources.captures import BATCH_PACKETS, read_captures


def append_parquet(stream: DataFrame, target: str, checkpoint: str, once: bool = True, by: list[str] | None = None) -> StreamingQuery:
    """Append a stream to Parquet, exactly once.

    ``once`` processes what there is, in as many micro-batches as the source's rate limit asks
    for, and stops.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(*by) if by else writer
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(target)


def ingest_captures(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    pattern: str = "*.pcap",
    files_per_batch: int = 100,
    batch: int = BATCH_PACKETS,
    large: int = 128 << 20,
    once: bool = True,
    **features: object,
) -> StreamingQuery:
    """Parse new capture files of any size below ``root`` and append their feature rows to ``target``."""
    packets = read_captures(spark, root, pattern, large, batch, stream=True, maxFilesPerTrigger=str(files_per_batch))
    return append_parquet(feature_rows(packets, **features), target, checkpoint, once)
