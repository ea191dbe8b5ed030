from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from packetloom.functions.octets import hex_text
from packetloom.operators import packets
from packetloom.plans.capture_features import captures_to_features, packets_to_fields, extracts_to_flows
from packetloom.sources.captures import capture_files, parse_captures, read_captures, scan_ranges
from packetloom.sources.files import directory_ids, list_files
from packetloom.streaming.ingest import ingest_captures
from tests.captures import PAYLOAD, SHAPES, capture, ether, ipv4, tcp, udp, write


@pytest.fixture
def captures(folder):
    data = [p for _, p, _, _ in SHAPES]
    write(folder, "web.a/one.pcap", capture(data))
    write(folder, "Mail/two.pcap", capture(data[:3], order=">"))
    write(folder, "p2p/deep/three.pcap", capture(data[3:6], nano=True, cut=100))
    write(folder, "p2p/deep/notes.txt", b"not a capture")
    return folder


def frames(spark, rows):
    df = spark.createDataFrame([(i, bytearray(p), 1) for i, p in enumerate(rows)], "id int, packet binary, link_type int")
    return df


def test_read_all_files(spark, captures):
    rows = read_captures(spark, captures).orderBy("file_path", "frame_no").collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r["label"], []).append(r)
    assert {k: len(v) for k, v in by_label.items()} == {"web.a": len(SHAPES), "Mail": 3, "deep": 3}
    assert [bytes(r["packet"]) for r in by_label["web.a"]] == [p for _, p, _, _ in SHAPES]
    assert [r["truncated"] for r in by_label["deep"]] == [False, False, True]
    last = by_label["deep"][-1]
    assert (len(last["packet"]), last["cap_len"]) == (len(SHAPES[5][1]) - 100, len(SHAPES[5][1]))
    assert [r["frame_no"] for r in by_label["Mail"]] == [1, 2, 3]


def test_times_of_all_byte_orders(spark, folder):
    for name, order, nano in [("a", "<", False), ("b", ">", False), ("c", "<", True), ("d", ">", True)]:
        write(folder, f"{name}/x.pcap", capture([SHAPES[0][1]] * 2, order, nano))
    times = read_captures(spark, folder).select("label", F.unix_micros("ts").alias("t")).collect()
    assert {r["t"] for r in times} == {1700000000000005, 1700000001000006}
    assert len(times) == 8


def test_ranges_equal_whole_files(spark, folder):
    data = [ether(ipv4(tcp(0x18, bytes([i % 256]) * (i % 700)), 6)) for i in range(500)]
    write(folder, "x/big.pcap", capture(data))
    whole = parse_captures(capture_files(spark, folder))
    pieces = scan_ranges(capture_files(spark, folder, content=False), target=10_000)
    cut = read_captures(spark, folder, large=1000)
    columns = ["frame_no", F.unix_micros("ts").alias("t"), "cap_len", "wire_len", "link_type", "truncated", hex_text("packet").alias("p"), "label"]
    expected = whole.select(*columns).orderBy("frame_no").collect()
    assert len(expected) == 500
    for other in (pieces, cut):
        assert other.select(*columns).orderBy("frame_no").collect() == expected


def test_first_batches_only(spark, captures):
    rows = read_captures(spark, captures, batch=2, max_batches=2)
    assert rows.groupBy("label").count().where("label = 'web.a'").first()["count"] == 4


def test_not_a_capture(spark, folder):
    write(folder, "x/bad.pcap", b"no header here, just some text of enough bytes")
    with pytest.raises(Exception, match="not a capture file"):
        read_captures(spark, folder).count()


def test_omitted(spark):
    df = packets.dissect(frames(spark, [p for _, p, _, _ in SHAPES]))
    rows = df.select("id", packets.omitted().alias("t"), packets.omitted("ip").alias("i")).orderBy("id").collect()
    assert [(not r["t"], not r["i"]) for r in rows] == [(t, i) for _, _, t, i in SHAPES]


def test_dissected_fields(spark):
    df = packets.dissect(frames(spark, [p for _, p, _, _ in SHAPES])).orderBy("id")
    rows = {SHAPES[r["id"]][0]: r for r in df.collect()}
    r = rows["tcp payload"]
    assert (r["l3"], r["l4"], r["sport"], r["dport"], r["tcp_flags"], r["payload_len"]) == (15, 35, 40000, 443, 16, 300)
    assert (r["ip_src"], r["ip_dst"]) == ("0a010203", "c0a80709")
    assert (rows["ack, padding"]["payload_len"], rows["ack, padding"]["trailing"]) == (0, 6)
    assert (rows["tagged tcp"]["l3"], rows["tagged tcp"]["payload_len"]) == (19, 6)
    assert (rows["ip options"]["l4"], rows["ip options"]["payload_len"]) == (43, 7)
    assert rows["ipv6 tcp"]["ip_src"] == bytes(range(16)).hex()
    assert rows["icmp"]["sport"] is None and rows["arp"]["ip_version"] is None
    assert rows["runt"]["eth_type"] is None and rows["runt"]["proto"] is None


def test_raw_ip_link(spark):
    raw = ipv4(tcp(0x18, b"raw"), 6)
    df = spark.createDataFrame([(bytearray(raw), 101, "x")], "packet binary, link_type int, label string")
    row = packets.feature_rows(df).first()
    assert row["feature_len"] == len(raw) and bytes(row["x"][12:24]) == bytes(12)


def test_features(spark):
    df = frames(spark, [p for _, p, _, _ in SHAPES]).withColumn("label", F.lit("web"))
    rows = {SHAPES[r["id"]][0]: r for r in packets.feature_rows(df, carry=["id"]).collect()}
    assert set(rows) == {name for name, _, kept, _ in SHAPES if kept}
    r = rows["tcp payload"]
    expected = bytearray(SHAPES[0][1][14:])
    expected[12:24] = bytes(12)
    assert bytes(r["x"]) == bytes(expected) + bytes(1024 - len(expected))
    assert (r["feature_len"], r["labels"]) == (340, "web")
    assert rows["long udp"]["feature_len"] == 1024 == len(rows["long udp"]["x"])
    six = bytes(rows["ipv6 tcp"]["x"])
    assert six[8:40] == bytes(range(32)) and six[40:44] == bytes(4)
    options = bytes(rows["ip options"]["x"])
    assert options[12:20] == bytes(8) and options[28:32] == bytes(4)
    masked = packets.feature_rows(df, carry=["id"], mask_ipv6=True).where("id = 9").first()
    assert bytes(masked["x"][8:44]) == bytes(36)


def test_widened_udp(spark):
    df = frames(spark, [ether(ipv4(udp(b"data"), 17))]).withColumn("label", F.lit("x"))
    narrow, wide = packets.feature_rows(df).first(), packets.feature_rows(df, widen_udp=True).first()
    assert bytes(wide["x"][:28]) == bytes(narrow["x"][:28])
    assert bytes(wide["x"][28:44]) == bytes(12) + b"data"
    assert wide["feature_len"] == narrow["feature_len"] + 12


def test_payload_and_snap(spark):
    df = packets.dissect(frames(spark, [p for _, p, _, _ in SHAPES]))
    kept = {SHAPES[r["id"]][0]: r for r in packets.with_payload(df).withColumn("data", packets.payload()).collect()}
    assert set(kept) == {"tcp payload", "long udp", "name service", "ipv6 tcp", "tagged tcp", "ip options"}
    assert bytes(kept["tcp payload"]["data"]) == PAYLOAD
    cut = packets.snapped(frames(spark, [SHAPES[5][1]])).first()
    assert len(cut["packet"]) == 222


def test_job_and_stream_agree(spark, captures, folder):
    for target in (f"{folder}/batch", f"{folder}/stream"):
        if target.endswith("batch"):
            captures_to_features(spark, captures, target)
        else:
            query = ingest_captures(spark, captures, target, f"{folder}/progress", files_per_batch=1)
            query.awaitTermination()
            assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 3
    sides = [
        sorted((r["h"], r["feature_len"], r["labels"]) for r in spark.read.parquet(t).withColumn("h", hex_text("x")).collect())
        for t in (f"{folder}/batch", f"{folder}/stream")
    ]
    assert sides[0] == sides[1] and len(sides[0]) > 8


def test_fields(spark, folder):
    there = ipv4(tcp(0x18, b"ab", 1000, 80), 6)
    back = ipv4(tcp(0x18, b"cd", 80, 1000), 6, src=bytes([192, 168, 7, 9]), dst=bytes([10, 1, 2, 3]))
    other = ipv4(udp(b"ef", 1000, 80), 17)
    write(folder, "x/c.pcap", capture([ether(p) for p in (there, other, back, there)]))
    rows = packets_to_fields(read_captures(spark, folder)).orderBy("frame_no").collect()
    assert [r["stream"] for r in rows] == [0, 0, 0, 0]  # each protocol from 0
    assert rows[2]["ip_src"] == "192.168.7.9"
    assert [r["payload"] for r in rows] == ["6162", "6566", "6364", "6162"]
    assert [round(r["time_relative"], 6) for r in rows] == [0, 1.000001, 2.000002, 3.000003]
    assert [r["protocol"] for r in rows] == ["tcp", "udp", "tcp", "tcp"]


def test_file_listing(spark, captures):
    rows = list_files(spark, captures, "*.pcap", threshold=300).collect()
    assert {(r["split"], r["dataset"]) for r in rows} == {("web.a", "one"), ("Mail", "two"), ("p2p/deep", "three")}
    ids = directory_ids(list_files(spark, captures, "*.pcap")).orderBy("label_id").collect()
    assert [(r["label_id"], r["label"]) for r in ids] == [(0, "deep"), (1, "Mail"), (2, "web.a")]


def test_same_stems_are_flagged(spark, folder):
    for name in ("a/x y.pcap", "a/x+y.pcap", "a/z.pcap"):
        write(folder, name, capture([SHAPES[0][1]]))
    rows = list_files(spark, folder, "*.pcap").collect()
    assert sorted((r["dataset"], r["duplicate"]) for r in rows) == [("x_y", True), ("x_y", True), ("z", False)]


def test_extract_files_to_flows(spark, folder):
    header = "frame.number,frame.time_relative,tcp.stream,ip.src,tcp.srcport,ip.dst,tcp.dstport,frame.len,ip.len,tcp.payload"
    lines = [f"{i + 1},{i * 0.1},{i % 5},1.1.1.1,1,2.2.2.2,2,60,40,{i:04x}" for i in range(20)]
    lines += ["", "broken,line,without,numbers,,,,,,"]
    write(folder, "in/day one/a_TCP.csv", ("\n".join([header, *lines]) + "\n").encode())
    write(folder, "in/day one/tiny_TCP.csv", (header[:50] + "\n").encode())
    write(folder, "in/day one/a_UDP.csv", b"not,read\n")
    members = extracts_to_flows(spark, f"{folder}/in", f"{folder}/out", share=None)
    rows = members["day one"].df.orderBy("tcp_stream").collect()
    assert [r["tcp_stream"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[1]["tcp_payload"].hex() == "0001" + "0006" + "000b" + "0010"
    assert {r["dataset"] for r in rows} == {"a_TCP"}
    manifest = [json.loads(line) for line in spark.read.text(f"{folder}/out/manifest").toPandas()["value"]]
    assert [(m["kind"], m["splits"]) for m in manifest] == [("members", ["day one"])]


def test_paths_and_sizes_make_no_difference(spark, folder):
    from packetloom.plans.capture_features import captures_to_features
    from packetloom.streaming.ingest import ingest_captures

    frames = [SHAPES[0][1], SHAPES[5][1]] * 13_000
    write(folder, "in/a b%20+c/x.pcap", capture(frames))
    write(folder, "in/p2p/y.pcap", capture(frames[:5]))
    small = read_captures(spark, f"{folder}/in")
    ranges = read_captures(spark, f"{folder}/in", large=100)
    assert small.count() == ranges.count() == 26_005
    assert small.exceptAll(ranges).isEmpty()
    pieces = scan_ranges(capture_files(spark, f"{folder}/in", content=False), target=100_000)
    assert pieces.rdd.getNumPartitions() > 4
    assert pieces.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    captures_to_features(spark, f"{folder}/in", f"{folder}/batch")
    ingest_captures(spark, f"{folder}/in", f"{folder}/stream", f"{folder}/progress", large=1000).awaitTermination()
    batch, stream = spark.read.parquet(f"{folder}/batch"), spark.read.parquet(f"{folder}/stream")
    assert batch.count() == stream.count() > 25_000
    assert batch.exceptAll(stream).isEmpty()


def test_masking_with_large_types(spark, captures):
    from packetloom.operators.packets import feature_rows

    rows = feature_rows(read_captures(spark, captures)).collect()
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert sorted(feature_rows(read_captures(spark, captures)).collect(), key=repr) == sorted(rows, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_ranges_that_guess_wrong_are_put_right(spark, folder):
    from packetloom.sources import captures as source

    # Payloads that hold captures of their own look like records in the middle of a record.
    inner = capture([bytes([i % 256]) * 40 for i in range(400)])[24:]
    write(folder, "x/nested.pcap", capture([inner, *[ether(bytes(30))] * 50] * 12))
    write(folder, "x/long.pcap", capture([bytes(60_000)] * 5 + [b"short"]))
    write(folder, "x/empty.pcap", capture([]))
    write(folder, "x/cut.pcap", capture([b"0123456789" * 300] * 7, order=">", nano=True, cut=5))
    files = capture_files(spark, folder, content=False)
    columns = ["file_path", "frame_no", F.unix_micros("ts").alias("t"), "cap_len", "wire_len", "truncated", hex_text("packet").alias("p")]
    expected = sorted(parse_captures(capture_files(spark, folder)).select(*columns).collect())
    guessed = source._dealt(files.select("path", F.lit(1).cast("long").alias("k"), F.lit(8000).cast("long").alias("begin"), F.lit(9000).cast("long").alias("end"), F.lit(None).cast("long").alias("start")))
    found = {r["path"].rpartition("/")[2]: r["start"] for r in guessed.where("path like '%nested%'").mapInPandas(source._walked, source.RANGE_TYPES).collect()}
    assert 8000 <= found["nested.pcap"] < 9000  # inside the first record
    for target in (4000, 50_000):
        assert sorted(scan_ranges(files, target=target).select(*columns).collect()) == expected
    rounds, source.ROUNDS = source.ROUNDS, 0  # as if they never met
    try:
        assert sorted(scan_ranges(files, target=4000).select(*columns).collect()) == expected
    finally:
        source.ROUNDS = rounds


def test_small_files_share_batches(spark, folder):
    for i in range(40):
        write(folder, f"d{i % 3}/{i}.pcap", capture([b"packet %d" % i] * 3))
    rows = read_captures(spark, folder).coalesce(1)
    assert rows.count() == 120
    sizes = rows.mapInArrow(lambda it: (b.select(["frame_no"]).slice(0, 1) for b in it), "frame_no long").count()
    assert sizes <= 2


def test_written_files(spark, folder):
    from packetloom.sources.captures import write_files

    files = spark.createDataFrame([(f"a b/{i}.pcap", bytearray(capture([b"x" * i]))) for i in range(9)], "path string, content binary")
    assert write_files(files, folder) == 9
    assert read_captures(spark, folder).agg(F.sum("cap_len")).first()[0] == 36
