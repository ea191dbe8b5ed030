"""Running counts: label distribution, confusion counts, time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows per key so far; with ``label, pred`` as keys these are running confusion counts."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def publish_states(counts: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the complete counts after every micro-batch to one of two slots of ``target`` in turn.

    The last state stays whole while the next is written; a repeated batch replaces its own slot.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{target}/slot={batch % 2}")

    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """The counts after the last micro-batch."""
    states = spark.read.parquet(target)
    last = states.agg(F.max("batch").alias("batch"))
    return states.join(last, "batch", "left_semi").drop("batch", "slot")


def sliced_counts(stream: DataFrame, ts: Column, delay: str, length: str, *keys: str) -> DataFrame:
    """Rows per clock-aligned time slice; rows later than ``delay`` are dropped.

    Slices start at multiples of their length since the epoch, not at the first packet.
    """
    timed = stream.withColumn("_ts", ts).withWatermark("_ts", delay)
    counts = timed.groupBy(F.window("_ts", length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("slice_start"), F.col("w.end").alias("slice_end"), *keys, "n")
