"""Streaming forms, run to the end of what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.octets import hex_text
from packetloom.operators.stored import new_path
from packetloom.streaming.closing import append_marker
from packetloom.streaming.counts import latest_state, publish_states, running_counts, sliced_counts
from packetloom.streaming.flows import live_flows
from packetloom.streaming.ingest import append_parquet, ingest_captures
from queries.derived import DOCUMENT_PACKETS_SQL, written_captures
from queries.registry import query, table


def stream(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder of files; a source takes a single file by a pattern only."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def closed(spark, rows, make, name, ts, seconds, **values):
    """What a stream emits from ``rows`` and then, begun again at its checkpoint, from a closing marker."""
    source, target, progress = new_path(spark, f"{name}-source"), new_path(spark, name), new_path(spark, f"{name}-progress")
    rows.write.parquet(source)
    made = make(spark.readStream.schema(rows.schema).parquet(source))
    append_parquet(made, target, progress).awaitTermination()
    append_marker(spark, source, rows, ts, seconds, **values)
    made = make(spark.readStream.schema(rows.schema).parquet(source))
    append_parquet(made, target, progress).awaitTermination()
    return spark.read.schema(made.schema).parquet(target)


@query(
    "s1_captures_to_features",
    f"WITH {DOCUMENT_PACKETS_SQL} SELECT rpad(substr(ip_head || repeat('0', 24) || tcp_tail, 1, 2048), 2048, '0') AS x, "
    "least(size + 40, 1024)::BIGINT AS feature_len, lang AS labels FROM d",
)
def s1(spark, sf_dir):
    target = new_path(spark, "features")
    query_ = ingest_captures(spark, written_captures(spark, sf_dir), target, new_path(spark, "features-progress"), large=1 << 18)
    query_.awaitTermination()
    return spark.read.parquet(target).withColumn("x", hex_text("x"))


@query("s2_running_label_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s2(spark, sf_dir):
    target = new_path(spark, "label-counts")
    counts = running_counts(stream(spark, sf_dir, "events"), "event_type")
    publish_states(counts, target, new_path(spark, "label-counts-progress")).awaitTermination()
    return latest_state(spark, target)


@query("s2_running_confusion", "SELECT quality AS label, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2")
def s2b(spark, sf_dir):
    target = new_path(spark, "confusion")
    pairs = stream(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    publish_states(running_counts(pairs, "label", "pred"), target, new_path(spark, "confusion-progress")).awaitTermination()
    return latest_state(spark, target)


@query(
    "s3_time_slices",
    "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS slice_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def s3(spark, sf_dir):
    def slices(events):
        return sliced_counts(events, F.col("ts").cast("timestamp"), "1 hour", "3600 seconds", "event_type")

    read = closed(spark, table(spark, sf_dir, "events"), slices, "slices", "ts", 3 * 3600)
    return read.select(F.unix_micros("slice_start").alias("slice_start"), "event_type", "n")


@query(
    "s4_live_flows",
    "WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, lower(hex(encode(props))) AS p FROM events WHERE props IS NOT NULL), "
    "g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), "
    "s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM g), "
    "f AS (SELECT user_id::VARCHAR AS flow, min(us) AS start, max(us) AS \"end\", count(*) AS n_packets, "
    "substr(string_agg(p, '' ORDER BY us, event_id), 1, 2048) AS payload FROM s GROUP BY user_id, n) "
    "SELECT * FROM f",
)
def s4(spark, sf_dir):
    ts, text = F.col("ts").cast("timestamp"), F.lower(F.hex(F.encode("props", "utf-8")))

    def flows(events):
        return live_flows(events, F.col("user_id"), ts, F.col("event_id"), text, 21600, "1 hour")

    rows = table(spark, sf_dir, "events")
    read = closed(spark, rows, flows, "live-flows", "ts", 9 * 3600, user_id=F.lit(-1), props=F.lit(""))
    return read.withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end")})
