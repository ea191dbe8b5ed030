"""Numbers by ranges of an order, the ends of flow prefixes, patterns in many texts, Arrow kernels."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from packetloom.functions import arrays, octets, wide
from packetloom.functions.patterns import Patterns
from packetloom.operators import flows, labels
from packetloom.operators.ranking import numbered, numbered_within
from packetloom.operators.sampling import sample_with_replacement
from packetloom.sources.files import directory_ids


def test_numbered(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(50), rng.choice("ab")) for i in range(3000)] + [(None, None, "a"), (None, 3, None)]
    df = spark.createDataFrame(rows, "id int, v int, k string").repartition(7)
    got = numbered(df, [F.col("v").desc(), F.col("id").asc()], "n").collect()
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or 0))
    assert [(r["id"], r["v"]) for r in sorted(got, key=lambda r: r["n"])] == [r[:2] for r in wanted]
    assert sorted(r["n"] for r in got) == list(range(1, len(rows) + 1))
    per_key = numbered_within(df, ["k"], [F.col("id").asc()], "n", start=0).collect()
    for k in ("a", "b", None):
        own = sorted([r for r in per_key if r["k"] == k], key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(len(own)))
        assert [r["id"] for r in own] == sorted((r["id"] for r in own), key=lambda i: (i is not None, i or 0))
    assert numbered(df.where("false"), [F.col("id").asc()]).count() == 0
    assert numbered_within(df.where("false"), ["k"], [F.col("id").asc()]).count() == 0


def test_a_million_values_are_numbered_without_one_window(spark):
    values = spark.range(1_000_000).select((F.col("id") * 7 % 1_000_003).alias("labels"), F.lit(1).alias("x"))
    coded, mapping = labels.encode_classes(values.withColumn("labels", F.format_string("%07d", "labels")), "labels")
    plans = [labels.label_mapping(values), labels.dense_labels(values), coded, mapping]
    for df in plans:
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert plans[0].agg(F.min("label_id"), F.max("label_id"), F.count_distinct("label_id")).first() == (0, 999_999, 1_000_000)
    assert plans[0].withColumn("before", F.expr("label < 500000")).where("before").agg(F.max("label_id")).first()[0] < 500_000
    assert plans[1].agg(F.max("labels"), F.count_distinct("labels")).first() == (999_999, 1_000_000)
    assert coded.agg(F.count_distinct("labels")).first()[0] == 1_000_000


def test_directories_keep_their_order(spark):
    listing = spark.createDataFrame([(f"/r/{d}/f{i}.pcap", 1) for i in range(5) for d in ("b", "A", "a", "C")], "path string, length long")
    assert [tuple(r) for r in directory_ids(listing).orderBy("label_id").collect()] == [("A", 0), ("a", 1), ("b", 2), ("C", 3)]


def test_draws_by_runs(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(40)], "id int, label string")
    got = sample_with_replacement(df, ["id"], 25_000).groupBy("label").agg(F.count_distinct("draw").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r["label"], r["d"], r["n"]) for r in got} == {("x", 25_000, 25_000), ("y", 25_000, 25_000)}
    assert sample_with_replacement(df, ["id"], 0).count() == 0


def test_flow_prefixes_of_any_length(spark):
    rng = random.Random(8)
    rows, number = [], 0
    for flow in range(60):
        for _ in range(rng.choice([1, 3, 40, 400])):
            number += rng.choice([1, 1, 5000])
            rows.append((flow if flow else None, number, rng.choice(["", "ab", "abcd", "0123456789" * rng.randrange(30), None])))
    rows += [(77, 10_000_000 + i, "aa" if i % 3 else "") for i in range(9000)]  # hot and long
    rows += [(78, i, "") for i in range(50)] + [(79, 1, None)]
    df = spark.createDataFrame(rows, "flow int, frame_no long, payload string").repartition(5)
    for width in (16, 2048):
        got = {r["flow"]: (bytes(r["tcp_payload"]).hex(), r["payload_len"]) for r in flows.assembled(df, ["flow"], width=width).collect()}
        wanted = {}
        for flow, _, payload in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1]):
            wanted[flow] = wanted.get(flow, "") + payload
        assert got == {k: (v[:width], len(v[:width]) // 2) for k, v in wanted.items()}
    # Behind the ends nothing moves: the filter stands below the only exchange.
    plan = flows.assembled(df, ["flow"], width=16)._jdf.queryExecution().executedPlan().toString()
    tree = plan.splitlines()
    exchange = next(i for i, line in enumerate(tree) if re.search(r"Exchange hashpartitioning\(flow", line))
    assert any("Filter" in line and "_last" in line for line in tree[exchange:])
    ends = flows.prefix_ends(df.select("flow", F.col("frame_no").alias("_at"), F.length("payload").alias("_len")), ["flow"], 2048)
    assert 77 in {r["flow"] for r in ends.collect()}


def test_patterns_against_brute_force():
    rng = random.Random(12)
    texts = [None, "", "é", "abcabcabcabcabc"] + ["".join(rng.choice("abé0") for _ in range(rng.randrange(90))) for _ in range(200)]
    texts[7] = "ab" * 2_000_000  # longer than a block
    patterns = {"a", "é", "ab", "abc", "bca", "aaaaaaaa", "aaaaaaaaa", "0" * 30, "ab" * 15}
    patterns |= {t[i : i + n] for t in texts[8:60] for n in (1, 2, 5, 8, 9, 12, 30) for i in (0, 4) if len(t) >= i + n}
    known = Patterns([p.encode() for p in patterns])
    for step in (1, 2):
        got = set()
        for rows, numbers in known.found(pa.array(texts), step):
            pairs = list(zip(rows.tolist(), numbers.tolist()))
            assert len(pairs) == len(set(pairs)) and not got & set(pairs)
            got |= set(pairs)
        wanted = set()
        for i, text in enumerate(texts):
            data = (text or "").encode()
            for n, p in enumerate(known.patterns):
                at = data.find(p)
                while at >= 0 and at % step:
                    at = data.find(p, at + 1)
                if at >= 0:
                    wanted.add((i, n))
        assert got == wanted


def test_patterns_with_equal_codes():
    # Windows that a polynomial takes for the pattern are compared byte by byte.
    known = Patterns([b"abcdefghij"])
    length = 10
    codes, numbers, content = known.by_length[length]
    known.by_length[length] = np.array([known._codes(np.frombuffer(b"0123456789", np.uint8), length)[0]]), numbers, content
    assert [len(rows) for rows, _ in known.found(pa.array(["x0123456789x"]))] == [0]


def test_arrow_kernels_give_what_the_expressions_give(spark):
    rng = random.Random(6)
    rows = [(0, None), (1, b""), (2, bytes(range(256))), (3, b"\x00"), (4, bytes(2000))] + [(5 + i, rng.randbytes(rng.randrange(100))) for i in range(60)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "id int, b binary").repartition(3)
    b, width = F.col("b"), 64
    floats = df.select("id", arrays.unit_floats(b, width).alias("v"))
    pairs = [
        (wide.unit_floats_arrow(b, width), arrays.unit_floats(b, width)),
        (wide.byte_values_arrow(b), octets.byte_values(b)),
        (wide.normalised_arrow(b, width, 0.25, 0.5), arrays.normalised(b, width, 0.25, 0.5)),
        (wide.normalised_arrow(b, width, 0.25, 0.5, "after"), arrays.normalised(b, width, 0.25, 0.5, "after")),
        (wide.patch_values_arrow(b, 16, 4), arrays.patchify(octets.byte_values(octets.crop_and_pad(b, width)), 16, 4)),
    ]
    for name, (ours, theirs) in enumerate(pairs):
        got = df.select("id", ours.alias("ours"), theirs.alias("theirs")).collect()
        for r in got:
            assert r["ours"] is None if r["id"] == 0 else r["ours"] == r["theirs"], (name, r["id"])
    few = spark.createDataFrame([(99, []), (100, [2.0]), (101, None)], "id int, v array<double>")
    s = {r["id"]: r["s"] for r in few.select("id", wide.moments_arrow(F.col("v")).alias("s")).collect()}
    assert tuple(s[99]) == (0.0, None, None) and tuple(s[100]) == (1.0, 2.0, None) and tuple(s[101]) == (None, None, None)
    moments = floats.where("v is not null").select("id", wide.moments_arrow(F.col("v")).alias("s"), arrays.mean(F.col("v")).alias("m"), arrays.sample_variance(F.col("v")).alias("var"))
    for r in moments.collect():
        assert abs(r["s"]["m"] - r["m"]) < 1e-12 and abs(r["s"]["var"] - r["var"]) < 1e-12
