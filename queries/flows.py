"""Flows on conversations, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.octets import hex_text
from packetloom.operators import flows
from packetloom.operators.packets import snapped_by_protocol
from packetloom.operators.sampling import sample_flows
from queries.registry import PACKETS_SQL, packets, query, table

P = f"WITH p AS ({PACKETS_SQL}) "
KEYS = ["file", "stream"]
ASSEMBLED = "SELECT file, stream, substr(string_agg(payload, '' ORDER BY frame_no), 1, 2048) AS t FROM {} GROUP BY file, stream"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY file, stream ORDER BY frame_no) AS rn FROM p) "


@query(
    "d8_flow_assembly",
    P + ", a AS (" + ASSEMBLED.format("p") + ") SELECT file, stream, t AS tcp_payload, (length(t) // 2)::INT AS payload_len FROM a",
)
def d8(spark, sf_dir):
    return flows.assembled(packets(spark, sf_dir), KEYS).withColumn("tcp_payload", hex_text("tcp_payload"))


@query(
    "d8_flow_assembly_lines",
    "WITH p AS (SELECT l_returnflag AS file, l_suppkey AS stream, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, "
    "l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS frame_no, printf('%06x', l_partkey::INT) AS payload FROM lineitem), a AS ("
    + ASSEMBLED.format("p") + ") SELECT file, stream, t AS tcp_payload, (length(t) // 2)::INT AS payload_len FROM a",
)
def d8b(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {"file": F.col("l_returnflag"), "stream": F.col("l_suppkey"), "ts": F.col("l_shipdate")}
    )
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = flows.numbered_frames(rows, ["file"], "ts", tie, bucket_seconds=86400 * 30)
    coded = numbered.withColumn("payload", F.lpad(F.lower(F.hex("l_partkey")), 6, "0"))
    return flows.assembled(coded, KEYS).withColumn("tcp_payload", hex_text("tcp_payload"))


@query(
    "f3_sampled_flow_assembly",
    P + ", s AS (SELECT DISTINCT file, stream FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY "
    "md5(concat_ws(':', '9876', file, stream))) AS rn, count(*) OVER (PARTITION BY file) AS c FROM s), "
    "q AS (SELECT p.* FROM p JOIN r ON r.file = p.file AND r.stream = p.stream WHERE rn <= c // 4), "
    "a AS (" + ASSEMBLED.format("q") + ") SELECT file, stream, t AS tcp_payload, (length(t) // 2)::INT AS payload_len FROM a",
)
def f3d8(spark, sf_dir):
    chosen = sample_flows(packets(spark, sf_dir), "file", "stream", 4)
    return flows.assembled(chosen, KEYS).withColumn("tcp_payload", hex_text("tcp_payload"))


def grid_sql(row: str, having: str, pad: str = "") -> str:
    return (
        P + ", " + RANKED + f"SELECT file, stream, string_agg({row}, '|' ORDER BY rn){pad} AS rows FROM r WHERE rn <= 4 "
        f"GROUP BY file, stream{having}"
    )


FILLED = "rpad(substr(payload, 1, 128), 128, '0')"


@query("d9_patch_grid", grid_sql(FILLED, " HAVING count(*) = 4"))
def d9(spark, sf_dir):
    return flows.patch_grid(packets(spark, sf_dir), KEYS).withColumn("rows", F.array_join("rows", "|"))


@query("d10_patch_grid_padded", grid_sql(FILLED, "", " || repeat('|' || repeat('0', 128), (4 - count(*))::INT)"))
def d10(spark, sf_dir):
    return flows.patch_grid(packets(spark, sf_dir), KEYS, short="pad").withColumn("rows", F.array_join("rows", "|"))


@query("d11_patch_list", grid_sql("substr(payload, 1, 128)", ""))
def d11(spark, sf_dir):
    return flows.patch_grid(packets(spark, sf_dir), KEYS, short="ragged").withColumn("rows", F.array_join("rows", "|"))


@query("d21_packets_per_unit", "SELECT l_orderkey, count(*) AS n_packets FROM lineitem GROUP BY 1")
def d21(spark, sf_dir):
    return flows.unit_sizes(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query(
    "b11_large_units",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN "
    "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 100 AND count(*) >= 4)",
)
def b11(spark, sf_dir):
    kept = flows.large_units(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 100, 4)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "b12_without_small_units",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN "
    "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 4)",
)
def b12(spark, sf_dir):
    kept = flows.without_small_units(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 4)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("e8_first_packets", P + "SELECT file, stream, frame_no, payload FROM p WHERE frame_no <= 3")
def e8(spark, sf_dir):
    return flows.first_packets(packets(spark, sf_dir), 3).select("file", "stream", "frame_no", "payload")


@query("e9_chunks", P + "SELECT file, stream, frame_no, (frame_no - 1) // 8 AS chunk_id FROM p")
def e9(spark, sf_dir):
    return packets(spark, sf_dir).select("file", "stream", "frame_no", flows.chunk_id().alias("chunk_id"))


@query(
    "e10_time_slices",
    "SELECT event_id, event_type, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) // 3600000000 AS slice_id FROM events",
)
def e10(spark, sf_dir):
    return flows.with_slices(table(spark, sf_dir, "events"), ["event_type"]).select("event_id", "event_type", "slice_id")


@query(
    "e11_frames_and_streams",
    "WITH f AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS frame_no, "
    "round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1000000.0::DOUBLE, 6) AS time_relative FROM events), "
    "s AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY min(frame_no)) - 1 AS stream FROM f GROUP BY 1, 2) "
    "SELECT f.event_id, f.frame_no, f.time_relative, s.stream FROM f JOIN s ON s.event_type = f.event_type AND s.user_id = f.user_id",
)
def e11(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    frames = flows.numbered_frames(events, ["event_type"], "ts", ["event_id"])
    streams = flows.with_streams(frames, ["event_type"], ["user_id"])
    return streams.select("event_id", "frame_no", F.round("time_relative", 6).alias("time_relative"), "stream")


@query(
    "e12_host_pairs",
    "SELECT least(l_partkey, l_suppkey) AS host_a, greatest(l_partkey, l_suppkey) AS host_b, count(*) AS n_packets, "
    "sum(l_quantity) AS n_bytes FROM lineitem GROUP BY 1, 2",
)
def e12(spark, sf_dir):
    keyed = table(spark, sf_dir, "lineitem").select("l_quantity", *flows.host_pair("l_partkey", "l_suppkey"))
    return flows.unit_sizes(keyed, ["host_a", "host_b"], "l_quantity")


@query(
    "e12_directed_flows",
    "SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n_packets FROM lineitem GROUP BY 1, 2, 3",
)
def e12b(spark, sf_dir):
    return flows.unit_sizes(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


@query(
    "e12_directed_five_tuples",
    "SELECT l_partkey AS src, l_linenumber AS sport, l_suppkey AS dst, (l_orderkey % 5)::INT AS dport, l_returnflag AS protocol, "
    "count(*) AS n_packets, sum(l_quantity) AS n_bytes FROM lineitem GROUP BY 1, 2, 3, 4, 5",
)
def e12d(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("sport"), F.col("l_suppkey").alias("dst"),
        (F.col("l_orderkey") % 5).cast("int").alias("dport"), F.col("l_returnflag").alias("protocol"), "l_quantity",
    )
    return flows.unit_sizes(lines, ["src", "sport", "dst", "dport", "protocol"], "l_quantity")


@query(
    "e12_sessions",
    "WITH k AS (SELECT l_partkey AS a, l_linenumber AS pa, l_suppkey AS b, 7::INT AS pb FROM lineitem), "
    "o AS (SELECT CASE WHEN (a, pa) <= (b, pb) THEN a ELSE b END AS host_a, CASE WHEN (a, pa) <= (b, pb) THEN pa ELSE pb END AS port_a, "
    "CASE WHEN (a, pa) <= (b, pb) THEN b ELSE a END AS host_b, CASE WHEN (a, pa) <= (b, pb) THEN pb ELSE pa END AS port_b FROM k) "
    "SELECT host_a, port_a, host_b, port_b, count(*) AS n_packets FROM o GROUP BY 1, 2, 3, 4",
)
def e12c(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("port", F.lit(7))
    keyed = lines.select(*flows.session_key("l_partkey", "l_linenumber", "l_suppkey", "port"))
    return flows.unit_sizes(keyed, ["host_a", "port_a", "host_b", "port_b"])


@query(
    "e13_snap_by_protocol",
    P + "SELECT file, stream, frame_no, protocol, CASE protocol WHEN 'UDP' THEN substr(payload, 1, 340) ELSE payload END AS payload "
    "FROM p WHERE protocol IN ('UDP', 'TCP')",
)
def e13(spark, sf_dir):
    raw = packets(spark, sf_dir).withColumn("payload", F.unhex("payload"))
    return snapped_by_protocol(raw, "payload").withColumn("payload", hex_text("payload"))


@query(
    "e11_packet_numbers",
    "SELECT l_returnflag, l_shipdate::DATE::VARCHAR AS day, count(*) AS n, max(frame_no) AS last FROM (SELECT *, row_number() OVER "
    "(PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS frame_no FROM lineitem) GROUP BY 1, 2",
)
def e11b(spark, sf_dir):
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = flows.numbered_frames(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_shipdate", tie, bucket_seconds=86400 * 30)
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")
    return numbered.groupBy("l_returnflag", day).agg(F.count(F.lit(1)).alias("n"), F.max("frame_no").alias("last"))
