"""Network frames and capture files that Spark builds from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.arrays import bind
from packetloom.operators.stored import new_path
from packetloom.sources.captures import write_files
from queries.registry import table

MTU = 1400


def _hex(c: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(c)), digits, "0")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Ethernet frame per event, of ten shapes by event id; the payload is the whole ``props``.

    0 TCP with payload, 1 TCP SYN, 2 bare ACK, 3 bare PSH, 4 bare ACK with link padding, 5 UDP,
    6 empty UDP, 7 name service, 8 ARP, 9 IPv6 TCP.
    """
    e = table(spark, sf_dir, "events")
    s = F.col("event_id") % 10
    full = s.isin(0, 5, 7, 9)
    body = F.when(full, F.lower(F.hex(F.encode(F.coalesce("props", F.lit("")), "utf-8")))).otherwise("")
    size = F.when(full, F.octet_length(F.encode(F.coalesce("props", F.lit("")), "utf-8"))).otherwise(0)
    sport, dport = _hex(1024 + F.col("user_id") % 60000, 4), F.when(s == 7, "0035").otherwise("01bb")
    src = F.concat(F.lit("0a00"), _hex(F.col("user_id") % 65536, 4))
    dst = F.concat(F.lit("c0a8"), _hex(F.col("event_id") % 250, 4))
    flags = F.when(s == 1, "02").when(s == 3, "08").otherwise("10")
    fragment = F.when(s.isin(1, 4), "4000").otherwise("0000")
    tcp = F.concat(
        sport, dport, _hex(F.col("event_id"), 8), F.lit("00000000"), F.lit("50"), flags, F.lit("ffffdead0000"), body
    )
    udp = F.concat(sport, dport, _hex((size + 8).cast("long"), 4), F.lit("cafe"), body)
    is_udp = s.isin(5, 6, 7)
    inner = F.when(is_udp, udp).otherwise(tcp)
    inner_size = size + F.when(is_udp, 8).otherwise(20)
    v4 = F.concat(
        F.lit("4500"),
        _hex((inner_size + 20).cast("long"), 4),
        _hex(F.col("event_id") % 65536, 4),
        fragment,
        F.lit("40"),
        F.when(is_udp, "11").otherwise("06"),
        F.lit("beef"),
        src,
        dst,
        inner,
        F.when(s == 4, "000000000000").otherwise(""),
    )
    v6 = F.concat(
        F.lit("60000000"), _hex(inner_size.cast("long"), 4), F.lit("0640" + "20010db8" + "00" * 8), src,
        F.lit("20010db8" + "00" * 8), dst, inner,
    )
    arp = F.concat(F.lit("0001080006040001"), F.lit("aabbccddee01"), src, F.lit("000000000000"), dst)
    frame = F.concat(
        F.lit("aabbccddee01aabbccddee02"),
        F.when(s == 8, F.concat(F.lit("0806"), arp)).when(s == 9, F.concat(F.lit("86dd"), v6)).otherwise(F.concat(F.lit("0800"), v4)),
    )
    built = e.withColumn("packet", F.unhex(frame))
    return built.select(
        "event_id",
        F.col("event_type").alias("label"),
        F.concat(F.lit("/captures/"), "event_type", F.lit("/day.pcap")).alias("file_path"),
        (F.col("event_id") + 1).alias("frame_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(1).alias("link_type"),
        "packet",
        F.octet_length("packet").cast("long").alias("wire_len"),
    )


def event_sql(src: str = "src", dst: str = "dst", sport: str = "sport", dport: str = "dport") -> str:
    """The same frames from their network layer on, as hex column ``l3`` with the given fields."""
    return f"""
    e0 AS (SELECT event_id, event_type AS label, event_id % 10 AS s, user_id, ts,
             CASE WHEN event_id % 10 IN (0, 5, 7, 9) THEN lower(hex(encode(coalesce(props, '')))) ELSE '' END AS body,
             printf('%04x', (1024 + user_id % 60000)::INT) AS sport,
             CASE WHEN event_id % 10 = 7 THEN '0035' ELSE '01bb' END AS dport,
             '0a00' || printf('%04x', (user_id % 65536)::INT) AS src,
             'c0a8' || printf('%04x', (event_id % 250)::INT) AS dst FROM events),
    e1 AS (SELECT *, CASE WHEN s IN (5, 6, 7)
             THEN {sport} || {dport} || printf('%04x', (length(body) // 2 + 8)::INT) || 'cafe' || body
             ELSE {sport} || {dport} || printf('%08x', event_id::INT) || '0000000050'
               || CASE s WHEN 1 THEN '02' WHEN 3 THEN '08' ELSE '10' END || 'ffffdead0000' || body END AS inn FROM e0),
    e AS (SELECT *, CASE
             WHEN s = 8 THEN '0001080006040001aabbccddee01' || src || '000000000000' || dst
             WHEN s = 9 THEN '60000000' || printf('%04x', (length(inn) // 2)::INT) || '064020010db80000000000000000' || src
               || '20010db80000000000000000' || dst || inn
             ELSE '4500' || printf('%04x', (length(inn) // 2 + 20)::INT) || printf('%04x', (event_id % 65536)::INT)
               || CASE WHEN s IN (1, 4) THEN '4000' ELSE '0000' END || '40'
               || CASE WHEN s IN (5, 6, 7) THEN '11' ELSE '06' END || 'beef' || {src} || {dst} || inn
               || CASE WHEN s = 4 THEN '000000000000' ELSE '' END END AS l3 FROM e1)"""


def document_captures(docs: DataFrame) -> DataFrame:
    """Every document as the content of one capture file: ``path, content``.

    The whole text is cut into TCP packets of at most 1400 payload bytes. Even ids are
    little-endian with microseconds, odd ids big-endian with nanoseconds.
    """
    x = F.encode("text", "utf-8")
    little = F.col("doc_id") % 2 == 0
    count = F.greatest(F.ceil(F.octet_length(x) / MTU), F.lit(1)).cast("int")

    def u32(value: Column) -> Column:
        h = _hex(value.cast("long"), 8)
        return F.when(little, F.concat(h.substr(7, 2), h.substr(5, 2), h.substr(3, 2), h.substr(1, 2))).otherwise(h)

    def record(i: Column, chunk: Column) -> Column:
        size = F.length(chunk) / 2
        length = u32(size + 54)
        part = F.when(little, i).otherwise(i * 1000)
        return F.concat(
            u32(F.lit(1700000000) + F.col("doc_id")), u32(part), length, length,
            F.lit("aabbccddee01aabbccddee020800" + "4500"), _hex((size + 40).cast("long"), 4), _hex(i.cast("long"), 4),
            F.lit("0000" + "4006beef" + "0a00"), _hex(F.col("doc_id") % 65536, 4), F.lit("c0a80001"), F.lit("c00001bb"),
            _hex((i * MTU).cast("long"), 8), F.lit("00000000" + "5018ffffdead0000"), chunk,
        )

    def all_records(text: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * 2 * MTU + 1, F.lit(2 * MTU)))
        return F.array_join(F.transform(pieces, lambda chunk, i: record(i, chunk)), "")

    header = F.when(little, "d4c3b2a10200040000000000000000000000040001000000").otherwise(
        "a1b23c4d00020004000000000000000000040000" + "00000001"
    )
    records = bind(F.lower(F.hex(x)), all_records)
    path = F.concat(F.lit("/captures/"), "lang", F.lit("/"), "doc_id", F.lit(".pcap"))
    return docs.select(path.alias("path"), F.unhex(F.concat(header, records)).alias("content"))


def capture_set(docs: DataFrame) -> DataFrame:
    """The captures of :func:`document_captures` put together: ``path, content``, a file per language, range of
    4096 ids, and byte order, so of 2048 documents at most."""
    parts = document_captures(docs.select("doc_id", "lang", "text")).select(
        F.regexp_extract("path", r"([^/]*)/\d+\.pcap$", 1).alias("lang"),
        F.regexp_extract("path", r"(\d+)\.pcap$", 1).cast("long").alias("doc_id"),
        F.hex("content").alias("digits"),
    )
    name = F.concat("lang", F.lit("/"), F.expr("doc_id div 4096"), F.lit("-"), F.col("doc_id") % 2, F.lit(".pcap"))
    files = parts.groupBy(name.alias("path")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "digits"))).alias("parts"))
    records = F.array_join(F.transform("parts", lambda p: F.substring(p["digits"], 49, 1 << 30)), "")
    header = F.substring(F.col("parts")[0]["digits"], 1, 48)
    return files.select("path", F.unhex(F.concat(header, records)).alias("content"))


def written_captures(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the shared one with the files of :func:`capture_set`."""
    root = new_path(spark, "captures")
    write_files(capture_set(table(spark, sf_dir, "documents")), root)
    return root


DOCUMENT_PACKETS_SQL = f"""
    d0 AS (SELECT doc_id, lang, lower(hex(encode(text))) AS hx, octet_length(encode(text)) AS n FROM documents),
    d1 AS (SELECT *, unnest(range(greatest(ceil(n / {MTU}.0)::BIGINT, 1))) AS i FROM d0),
    d2 AS (SELECT doc_id, lang, i, substr(hx, i * {2 * MTU} + 1, {2 * MTU}) AS chunk FROM d1),
    d AS (SELECT *, length(chunk) // 2 AS size, '4500' || printf('%04x', (length(chunk) // 2 + 40)::INT) || printf('%04x', i::INT)
           || '00004006beef' AS ip_head, '0a00' || printf('%04x', (doc_id % 65536)::INT) || 'c0a80001' AS addresses,
           printf('%08x', (i * {MTU})::INT) || '000000005018ffffdead0000' || chunk AS tcp_tail FROM d2)"""
