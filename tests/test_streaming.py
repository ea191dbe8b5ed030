from __future__ import annotations

import os
import random
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from packetloom.streaming.closing import append_marker
from packetloom.streaming.counts import latest_state, publish_states, running_counts, sliced_counts
from packetloom.streaming.flows import live_flows
from packetloom.streaming.ingest import append_parquet
from queries import streams

SCHEMA = "flow string, at long, n long, text string"


def make(seed=4, n=2000):
    """Packets roughly in time order; a pause of more than 60 s ends a session."""
    rng = random.Random(seed)
    rows, at = [], {f: 1_700_000_000 for f in range(6)}
    for i in range(n):
        f = 0 if rng.random() < 0.5 else rng.randrange(6)
        at[f] += rng.choice([0, 1, 5, 30, 61, 200])
        rows.append((f"f{f}", at[f], i, rng.randbytes(rng.randrange(60)).hex()))
    return rows


def source(spark, folder, rows, files):
    """One file per part, in order of time with some packets a little late."""
    rows = sorted(rows, key=lambda r: r[1] + random.Random(r[2]).randrange(20))
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA)
        part.coalesce(1).write.json(f"{folder}/in/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{folder}/in")


def sessions(rows, gap=60):
    out = []
    flows = defaultdict(list)
    for flow, at, n, text in rows:
        flows[flow].append((at, n, text))
    for flow, packets in flows.items():
        held = []
        for p in sorted(packets):
            if held and p[0] - held[-1][0] > gap:
                out.append((flow, held))
                held = []
            held.append(p)
        out.append((flow, held))
    return out


def test_live_flows_over_many_batches(spark, folder):
    rows = make()
    stream = source(spark, folder, rows, 8)
    ts = F.timestamp_seconds("at")
    flows = live_flows(stream, F.col("flow"), ts, F.col("n"), F.col("text"), 60, "2 minutes", width=256)
    append_parquet(flows, f"{folder}/out", f"{folder}/progress").awaitTermination()
    got = {(r["flow"], int(r["s"])): (int(r["e"]), r["n_packets"], r["payload"]) for r in spark.read.parquet(f"{folder}/out").selectExpr("*", "unix_seconds(start) s", "unix_seconds(end) e").collect()}
    last = max(r[1] for r in rows) - 120
    want = {
        (flow, held[0][0]): (held[-1][0], len(held), "".join(p[2] for p in held)[:256])
        for flow, held in sessions(rows)
        if held[-1][0] + 60 < last
    }
    assert len(want) > 100 and got == want


def test_counts_grow_with_the_batches(spark, folder):
    rows = make(n=300)
    stream = source(spark, folder, rows, 3)
    publish_states(running_counts(stream, "flow"), f"{folder}/out", f"{folder}/progress").awaitTermination()
    states = spark.read.parquet(f"{folder}/out").groupBy("batch").agg(F.sum("n").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in states] == [200, 300]  # the last two states
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += 1
    assert {r["flow"]: r["n"] for r in latest_state(spark, f"{folder}/out").collect()} == want


def test_counts_of_a_table_in_one_file_or_a_folder(spark, folder):
    rows = [("a", 0), ("a", 0), ("b", 1), (None, 1), (None, None), (None, None)]
    labels = spark.createDataFrame(rows, "quality string, toxic int")
    labels.repartition(3).write.parquet(f"{folder}/parts/labels.parquet")
    spark.createDataFrame([("z", 9)], labels.schema).write.parquet(f"{folder}/parts/other_labels.parquet")
    os.mkdir(f"{folder}/one")
    pq.write_table(labels.toArrow(), f"{folder}/one/labels.parquet")
    pq.write_table(labels.toArrow(), f"{folder}/one/other_labels.parquet")
    want = [("a", 0, 2), ("b", 1, 1), (None, 1, 1), (None, None, 2)]
    for place in ("parts", "one"):
        got = streams.s2b(spark, f"{folder}/{place}").select("label", "pred", "n").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_slices_equal_batch_over_closed_windows(spark, folder):
    rows = make(n=600)
    stream = source(spark, folder, rows, 3)
    slices = sliced_counts(stream, F.timestamp_seconds("at"), "5 minutes", "600 seconds", "flow")
    append_parquet(slices, f"{folder}/out", f"{folder}/progress").awaitTermination()
    got = {(r["flow"], r["s"]): r["n"] for r in spark.read.parquet(f"{folder}/out").selectExpr("flow", "unix_seconds(slice_start) s", "n").collect()}
    want = defaultdict(int)
    for flow, at, _, _ in rows:
        want[flow, at // 600 * 600] += 1
    end = max(r[1] for r in rows) - 300
    assert got == {k: n for k, n in want.items() if k[1] + 600 <= end}


def test_marker_closes_all_windows(spark, folder):
    rows = make(n=600)
    table = spark.createDataFrame(rows, "flow string, at long, n long, text string").withColumn("ts", F.timestamp_seconds("at"))
    table.repartition(3).write.parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
        slices = sliced_counts(stream, F.col("ts"), "5 minutes", "600 seconds", "flow")
        append_parquet(slices, f"{folder}/out", f"{folder}/progress").awaitTermination()

    run()
    append_marker(spark, f"{folder}/in", table, "ts", 1800, flow=F.lit("marker"))
    run()
    got = spark.read.parquet(f"{folder}/out")
    assert got.agg(F.sum("n")).first()[0] <= 600
    assert got.where("flow = 'marker'").isEmpty()
    last = max(r[1] for r in rows)
    open_before = [r for r in rows if r[1] // 600 * 600 + 600 > last - 300]
    assert open_before  # these came out only through the marker
    closed = {(r["flow"], r["s"]) for r in got.selectExpr("flow", "unix_seconds(slice_start) s").collect()}
    assert {(r[0], r[1] // 600 * 600) for r in open_before} <= closed
