"""Packet cleaning on frames built from events, capture parsing on documents, payload search."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.octets import hex_text
from packetloom.operators import flows, packets, search
from packetloom.plans.capture_features import numbered_fields
from packetloom.sources.captures import parse_captures, read_captures
from queries.derived import DOCUMENT_PACKETS_SQL, document_captures, event_frames, event_sql, written_captures
from queries.registry import query, table

ZERO4, ZERO8 = "'0000'", "'00000000'"


def dissected(spark, sf_dir):
    return packets.dissect(event_frames(spark, sf_dir))


@query(
    "a1_capture_packets",
    f"WITH {DOCUMENT_PACKETS_SQL} SELECT lang AS label, lang || '/' || (doc_id // 4096) || '-' || (doc_id % 2) || '.pcap' AS file_path, "
    "row_number() OVER (PARTITION BY lang, doc_id // 4096, doc_id % 2 ORDER BY doc_id, i) AS frame_no, (1700000000 + doc_id) * 1000000 + i AS ts, (size + 54)::BIGINT AS cap_len, (size + 54)::BIGINT AS wire_len, 1::INT AS link_type, "
    "false AS truncated, 'aabbccddee01aabbccddee020800' || ip_head || '0a00' || printf('%04x', (doc_id % 65536)::INT) || 'c0a80001c00001bb' || tcp_tail AS packet FROM d",
)
def a1(spark, sf_dir):
    # Files of over 256 kB are read by ranges of that size, the others whole.
    packets_ = read_captures(spark, written_captures(spark, sf_dir), large=1 << 18, target=1 << 18)
    path = F.regexp_extract("file_path", r"([^/]+/[^/]+)$", 1)
    return packets_.withColumns({"file_path": path, "ts": F.unix_micros("ts"), "packet": hex_text("packet")})


@query(
    "a4_field_extraction",
    "WITH " + event_sql() + ", k AS (SELECT *, CASE WHEN s IN (5, 6, 7) THEN 'udp' ELSE 'tcp' END AS protocol, "
    "CASE WHEN s = 9 THEN '20010db80000000000000000' || src ELSE src END AS ip_src, "
    "CASE WHEN s = 9 THEN '20010db80000000000000000' || dst ELSE dst END AS ip_dst FROM e WHERE s <> 8), "
    "c AS (SELECT *, least(ip_src || ':' || sport, ip_dst || ':' || dport) || protocol || greatest(ip_src || ':' || sport, ip_dst || ':' || dport) AS conv FROM k), "
    "f AS (SELECT label, protocol, conv, min(event_id) AS first FROM c GROUP BY 1, 2, 3), "
    "g AS (SELECT label, conv, row_number() OVER (PARTITION BY label, protocol ORDER BY first) - 1 AS stream FROM f) "
    "SELECT event_id + 1 AS frame_no, c.protocol, array_to_string([('0x' || substr(c.ip_src, i, 2))::INT FOR i IN [1, 3, 5, 7]], '.') AS ip_src, ('0x' || c.sport)::INT AS sport, array_to_string([('0x' || substr(c.ip_dst, i, 2))::INT FOR i IN [1, 3, 5, 7]], '.') AS ip_dst, ('0x' || c.dport)::INT AS dport, "
    "(length(l3) // 2 + 14)::BIGINT AS frame_len, ((CASE WHEN s = 9 THEN 40 ELSE 20 END) + length(inn) // 2)::INT AS ip_len, "
    "body AS payload, g.stream FROM c JOIN g ON g.label = c.label AND g.conv = c.conv WHERE s <> 9 AND length(body) > 0",
)
def a4(spark, sf_dir):
    fields = packets.extracted_fields(dissected(spark, sf_dir))
    keyed = fields.select("*", *flows.session_key("ip_src", "sport", "ip_dst", "dport"))
    return numbered_fields(keyed).drop("file_path", "ts", "host_a", "port_a", "host_b", "port_b")


@query(
    "b2_omitted_packets",
    "SELECT event_id, event_id % 10 IN (1, 2, 4, 6, 7, 8) AS by_tcp, event_id % 10 IN (1, 4, 6, 7, 8) AS by_ip FROM events",
)
def b2(spark, sf_dir):
    df = dissected(spark, sf_dir)
    return df.select("event_id", packets.omitted().alias("by_tcp"), packets.omitted("ip").alias("by_ip"))


@query("b3_without_link_header", "WITH " + event_sql() + " SELECT event_id, l3 AS packet FROM e")
def b3(spark, sf_dir):
    return dissected(spark, sf_dir).select("event_id", hex_text(packets.without_link_header()).alias("packet"))


@query("b4_masked_addresses", "WITH " + event_sql(ZERO8, ZERO8) + " SELECT event_id, l3 AS packet FROM e")
def b4(spark, sf_dir):
    masked = packets.masked_addresses(packets.without_link_header(), F.lit(1))
    return dissected(spark, sf_dir).select("event_id", hex_text(masked).alias("packet"))


@query("b5_masked_ports", "WITH " + event_sql(sport=ZERO4, dport=ZERO4) + " SELECT event_id, l3 AS packet FROM e")
def b5(spark, sf_dir):
    masked = packets.masked_ports(packets.without_link_header(), F.col("l4") - F.col("l3") + 1)
    return dissected(spark, sf_dir).select("event_id", hex_text(masked).alias("packet"))


@query(
    "b6_widened_udp",
    "WITH " + event_sql() + " SELECT event_id, CASE WHEN s IN (5, 6, 7) THEN substr(l3, 1, 56) || repeat('00', 12) || substr(l3, 57) "
    "ELSE l3 END AS packet FROM e",
)
def b6(spark, sf_dir):
    wide = packets.widened_udp(packets.without_link_header(), F.col("l4") - F.col("l3") + 1)
    return dissected(spark, sf_dir).select("event_id", hex_text(wide).alias("packet"))


@query(
    "b8_feature_rows",
    "WITH " + event_sql(ZERO8, ZERO8, ZERO4, ZERO4) + " SELECT event_id, rpad(substr(l3, 1, 2048), 2048, '0') AS x, "
    "least(length(l3) // 2, 1024)::BIGINT AS feature_len, label AS labels FROM e WHERE s IN (0, 3, 5, 9)",
)
def b8(spark, sf_dir):
    rows = packets.feature_rows(event_frames(spark, sf_dir), carry=["event_id"])
    return rows.withColumn("x", hex_text("x"))


@query(
    "b8_document_features",
    f"WITH {DOCUMENT_PACKETS_SQL} SELECT doc_id, i + 1 AS frame_no, rpad(substr(ip_head || repeat('0', 24) || tcp_tail, 1, 2048), 2048, '0') AS x, "
    "least(size + 40, 1024)::BIGINT AS feature_len, lang AS labels FROM d",
)
def b8b(spark, sf_dir):
    parsed = parse_captures(document_captures(table(spark, sf_dir, "documents")))
    doc = F.regexp_extract("file_path", r"([0-9]+)\.pcap$", 1).cast("long").alias("doc_id")
    rows = packets.feature_rows(parsed, carry=["file_path", "frame_no"])
    return rows.select(doc, "frame_no", hex_text("x").alias("x"), "feature_len", "labels")


@query(
    "b10_packets_with_payload",
    "WITH " + event_sql() + " SELECT event_id, CASE WHEN s IN (5, 7) THEN 'UDP' ELSE 'TCP' END AS protocol, body AS payload FROM e "
    "WHERE s IN (0, 5, 7, 9) AND length(body) > 0",
)
def b10(spark, sf_dir):
    kept = packets.with_payload(dissected(spark, sf_dir))
    return kept.select("event_id", "protocol", hex_text(packets.payload()).alias("payload"))


@query(
    "c5_template_match",
    "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def c5(spark, sf_dir):
    docs, templates = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search.matches(docs, ["doc_id"], "text", templates, ["item_id"], "text")


@query(
    "c5_short_template_match",
    "SELECT d.doc_id, t.p_name FROM documents d JOIN (SELECT DISTINCT p_name FROM (SELECT unnest(string_split(p_name, ' ')) AS p_name FROM part "
    "UNION ALL SELECT n_name FROM nation)) t ON contains(d.text, t.p_name)",
)
def c5b(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("p_name"))
    names = words.union(table(spark, sf_dir, "nation").select("n_name")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.matches(docs, ["doc_id"], "text", names.withColumn("t", F.col("p_name")), ["p_name"], "t")


@query(
    "c5_hex_template_match",
    "SELECT c.conv_id, c.turn, t.n_nationkey FROM conversations c JOIN "
    "(SELECT n_nationkey, lower(hex(encode(chr((97 + n_nationkey)::INT) || 'n '))) || '6' AS h FROM nation) t ON contains(lower(hex(encode(c.text))), t.h)",
)
def c5c(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.hex(F.encode("text", "utf-8"))).alias("h"))
    letter = F.chr((97 + F.col("n_nationkey")).cast("long"))
    needle = F.concat(F.lower(F.hex(F.encode(F.concat(letter, F.lit("n ")), "utf-8"))), F.lit("6"))
    templates = table(spark, sf_dir, "nation").select("n_nationkey", needle.alias("t"))
    return search.matches(turns, ["conv_id", "turn"], "h", templates, ["n_nationkey"], "t")
