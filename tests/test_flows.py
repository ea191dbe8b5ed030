from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows, search
from packetloom.operators.packets import snapped_by_protocol
from packetloom.operators.sampling import sample_flows


def make(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        stream = 0 if rng.random() < 0.5 else rng.randrange(1, 40)
        payload = None if rng.random() < 0.1 else rng.randbytes(rng.choice([0, 1, 3, 40, 200, 1500])).hex()
        rows.append((f"f{stream % 2}", stream, i + 1, payload))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make(6000)


@pytest.fixture(scope="module")
def packets(spark, rows):
    return spark.createDataFrame(rows, "file string, stream long, frame_no long, payload string").repartition(6)


def by_flow(rows):
    out = defaultdict(list)
    for file, stream, _, payload in sorted(rows, key=lambda r: r[2]):
        if payload is not None:
            out[file, stream].append(payload)
    return out


def test_assembly(packets, rows):
    got = {(r["file"], r["stream"]): (r["tcp_payload"].hex(), r["payload_len"]) for r in flows.assembled(packets, ["file", "stream"]).collect()}
    want = {k: "".join(v)[:2048] for k, v in by_flow(rows).items()}
    assert got == {k: (t, len(t) // 2) for k, t in want.items()}


def test_assembly_of_one_long_flow_of_small_packets(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("frame_no"), F.when(F.col("id") % 1000 == 999, F.lpad(F.hex("id"), 6, "0")).otherwise("").alias("payload"))
    row = flows.assembled(df, ["file"]).first()
    assert row["tcp_payload"].hex() == "".join(f"{i:06x}" for i in range(999, n, 1000))[:2048]


def test_assembly_groups_are_bounded(packets):
    # One shuffle, of packets that begin inside the prefix: at most as many as it has digits.
    plan = flows.assembled(packets, ["file", "stream"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [file") == 1 and plan.count("_last") >= 2
    lengths = packets.select("file", "stream", F.col("frame_no").alias("_at"), F.length("payload").alias("_len"))
    for width in (16, 2048):
        ends = flows.prefix_ends(lengths, ["file", "stream"], width)
        inside = lengths.where("_len > 0").join(ends, ["file", "stream"]).where("_at <= _last").groupBy("file", "stream").agg(F.count(F.lit(1)).alias("n"))
        assert inside.where(F.col("n") > width).isEmpty()


def test_odd_nibble(spark):
    df = spark.createDataFrame([("f", 1, 1, "ab"), ("f", 1, 2, "c")], "file string, stream int, frame_no int, payload string")
    assert flows.assembled(df, ["file", "stream"]).first()["tcp_payload"].hex() == "ab0c"


@pytest.mark.parametrize("short", ["drop", "pad", "ragged"])
def test_grids(packets, rows, short):
    got = {(r["file"], r["stream"]): r["rows"] for r in flows.patch_grid(packets, ["file", "stream"], short).collect()}
    want = {k: [p[:128] for p in v[:4]] for k, v in by_flow(rows).items()}
    if short != "ragged":
        want = {k: [p.ljust(128, "0") for p in v] for k, v in want.items()}
    if short == "drop":
        want = {k: v for k, v in want.items() if len(v) == 4}
    if short == "pad":
        want = {k: v + ["0" * 128] * (4 - len(v)) for k, v in want.items()}
    assert got == want


def test_short_flows(spark):
    df = spark.createDataFrame([("f", s, i, "aa") for s, n in ((1, 3), (2, 4)) for i in range(n)], "file string, stream int, frame_no int, payload string")
    assert [r["stream"] for r in flows.patch_grid(df, ["file", "stream"]).collect()] == [2]
    padded = {r["stream"]: r["rows"] for r in flows.patch_grid(df, ["file", "stream"], "pad").collect()}
    assert padded[1][3] == "0" * 128 and len(padded[1]) == 4
    with pytest.raises(ValueError):
        flows.patch_grid(df, ["file", "stream"], "other")


def test_grid_limits_before_the_shuffle(packets):
    plan = flows.patch_grid(packets, ["file", "stream"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_flow_sampling(packets, rows):
    kept = {(r["file"], r["stream"]) for r in sample_flows(packets, "file", "stream", 4).collect()}
    streams = defaultdict(set)
    for file, stream, _, _ in rows:
        streams[file].add(stream)
    assert {f: sum(k[0] == f for k in kept) for f in streams} == {f: len(s) // 4 for f, s in streams.items()}
    whole = sample_flows(packets, "file", "stream", 4).count()
    assert whole == sum((r[0], r[1]) in kept for r in rows)


def test_units(packets, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[0], r[1]] += 1
    bound = sorted(sizes.values())[len(sizes) // 2]
    kept = flows.without_small_units(packets, ["file", "stream"], bound).select("file", "stream").distinct().collect()
    assert {tuple(r) for r in kept} == {k for k, n in sizes.items() if n > bound}
    sized = packets.withColumn("len", F.coalesce(F.length("payload"), F.lit(0)))
    kept = flows.large_units(sized, ["file", "stream"], "len", 0, bound).select("file", "stream").distinct().collect()
    assert {tuple(r) for r in kept} == {k for k, n in sizes.items() if n >= bound}


def test_numbering(spark):
    rng = random.Random(5)
    data = [(i, "big" if rng.random() < 0.9 else "small", rng.randrange(10), 1_700_000_000 + rng.random() * 50_000) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, file string, host int, t double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = flows.with_streams(flows.numbered_frames(df, ["file"], "ts", ["id"], 600), ["file"], ["host"])
    rows = got.collect()
    for file in ("big", "small"):
        mine = sorted((r for r in rows if r["file"] == file), key=lambda r: r["frame_no"])
        assert [r["frame_no"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r["ts"], r["id"]) for r in mine] == sorted((r["ts"], r["id"]) for r in mine)
        seen = {}
        for r in mine:
            assert r["stream"] == seen.setdefault(r["host"], len(seen))
        assert mine[0]["time_relative"] == 0
        last = (mine[-1]["ts"] - mine[0]["ts"]).total_seconds()
        assert mine[-1]["time_relative"] == pytest.approx(last)


def test_slices_and_chunks(spark):
    df = spark.createDataFrame([("a", 10.0, 1), ("a", 3609.9, 8), ("a", 3610.0, 9), ("b", 9999.0, 17)], "f string, t double, frame_no int")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    rows = flows.with_slices(df, ["f"]).select("slice_id", flows.chunk_id().alias("c")).collect()
    assert sorted(map(tuple, rows)) == [(0, 0), (0, 0), (0, 2), (1, 1)]


def test_keys(spark):
    df = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1), ("a", 2, "b", 1)], "s string, sp int, d string, dp int")
    assert len({tuple(r) for r in df.select(*flows.host_pair("s", "d")).collect()}) == 1
    assert len({tuple(r) for r in df.select(*flows.session_key("s", "sp", "d", "dp")).collect()}) == 2


def test_snap_by_protocol(spark):
    df = spark.createDataFrame([("UDP", bytearray(300)), ("TCP", bytearray(300)), ("ICMP", bytearray(9))], "protocol string, packet binary")
    assert sorted((r["protocol"], len(r["packet"])) for r in snapped_by_protocol(df).collect()) == [("TCP", 300), ("UDP", 170)]


def test_template_search_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé\n") for _ in range(rng.randrange(120))) for _ in range(150)] + ["", "dd74s6dcAFabbbcd", "abc", "abcddd74s6d"]
    templates = ["abc", "abc.", "a", "é\n", "abab", "", "\n" * 3]
    templates += [t[i : i + n] for t in texts[:60] for n in (1, 6, 7, 8, 30, 31, 32, 60) for i in (0, 3, 17) if len(t) >= i + n]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    right = spark.createDataFrame(list(enumerate(templates)), "tid int, template string")
    got = sorted(map(tuple, search.matches(left, ["id"], "text", right, ["tid"], "template").collect()))
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, s in enumerate(templates) if s and s in t)
    plan = search.matches(left, ["id"], "text", right, ["tid"], "template")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_byte_aligned_search(spark):
    rng = random.Random(3)
    texts, templates = [rng.randbytes(30).hex() for _ in range(40)], [f"{i:x}" for i in range(16)] + [rng.randbytes(1).hex() for _ in range(40)]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, h string")
    right = spark.createDataFrame(list(enumerate(templates)), "tid int, t string")
    got = sorted(map(tuple, search.matches(left, ["id"], "h", right, ["tid"], "t", byte_aligned=True).collect()))
    assert got == sorted((i, j) for i, h in enumerate(texts) for j, t in enumerate(templates) if any(h.startswith(t, k) for k in range(0, 60, 2)))


def test_no_templates(spark):
    left = spark.createDataFrame([(1, "text")], "id int, text string")
    right = spark.createDataFrame([(1, "")], "tid int, template string")
    assert search.matches(left, ["id"], "text", right, ["tid"], "template").count() == 0


def test_hex_search(spark):
    df = spark.createDataFrame([(bytearray(b"\xab\xcd"),), (bytearray(b"\x0a\xbc"),)], "b binary")
    c = F.col("b")
    rows = df.select(search.contains_hex(c, "ABC").alias("x"), search.contains_hex(c, "abc", True).alias("y"), search.contains_hex(c, "abc", False).alias("z")).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (True, False, True)]
