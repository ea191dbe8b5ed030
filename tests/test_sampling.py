from __future__ import annotations

import math
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.functions.hashing import bernoulli, hash_key
from packetloom.operators import lengths, ranking, sampling
from packetloom.operators.members import Members
from packetloom.plans import train_test

SKEWED = [(i, "hot" if i % 100 else f"rare{i % 700 // 100}") for i in range(7000)]


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(SKEWED, "id long, labels string").repartition(5)


def order(seed, key):
    ranked = defaultdict(list)
    for i, label in SKEWED:
        ranked[label].append((md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return [i for _, i in sorted(ranked[key])]


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("n", [0, 1, 3, 10, 500, 6930, 100_000])
def test_cut_is_the_head_of_the_order(spark, skewed, n):
    kept = sampling.under_sample(skewed, ["id"], n)
    assert ids(kept) == sorted(i for label in {r[1] for r in SKEWED} for i in order(9876, label)[:n])


def test_rank_equals_window(spark, skewed):
    ranked = ranking.hash_rank(skewed, ["labels"], hash_key(9876, "id"))
    got = {r["id"]: r["rank"] for r in ranked.collect()}
    assert got == {i: n for label in {r[1] for r in SKEWED} for n, i in enumerate(order(9876, label), 1)}


def test_cut_does_not_move_rows_or_sort_a_class(spark, skewed):
    wide = skewed.withColumn("payload", F.repeat("labels", 50))
    plan = sampling.under_sample(wide, ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "Exchange hashpartitioning(labels" not in plan


@pytest.mark.parametrize("n", [1, 500, 2999, 3000, 3001, 5000, 100_000])
def test_cut_through_copies(spark, n):
    """A third of all rows are copies of one."""
    rows = [("same", "hot", b"x")] * 3000 + [(f"{i}", "hot", b"y") for i in range(3000)] + [("same", "cold", b"z")] * 40 + [("two", "two", b"1")] * 5 + [("two", "two", b"2")] * 4
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "id string, labels string, x binary").repartition(6)
    kept = Counter(r["labels"] for r in sampling.under_sample(df, ["id"], n).collect())
    assert kept == {label: min(n, size) for label, size in Counter(r[1] for r in rows).items()}
    parts = sampling.sample_and_split(df, ["id"], n, 0.3).collect()
    assert Counter((r["labels"], r["part"]) for r in parts) == Counter(
        {(label, part): k for label, size in Counter(r[1] for r in rows).items() for m in [min(n, size)]
         for part, k in (("test", int(m * 0.3)), ("train", m - int(m * 0.3))) if k}
    )
    whole = sampling.split_exact(df, ["id"], 0.3)
    assert whole.drop("part").exceptAll(df).isEmpty() and whole.count() == len(rows)
    test = whole.where("part = 'test'").groupBy("labels").count().collect()
    assert {r["labels"]: r["count"] for r in test} == {"hot": 1800, "cold": 12, "two": 2}


def test_copies_are_written_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PIECE", 7)
    df = spark.createDataFrame([("a", "l")] * 100, "id string, labels string")
    assert sampling.under_sample(df, ["id"], 33).count() == 33
    assert Counter(r["part"] for r in sampling.split_exact(df, ["id"], 0.5).collect()) == {"test": 50, "train": 50}


def test_null_labels_are_a_class_of_their_own(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id long, labels string")
    counts = Counter(r["labels"] for r in sampling.under_sample(df, ["id"], 7).collect())
    assert counts == {None: 7, "a": 7}
    assert sampling.split_exact(df, ["id"], 0.5).count() == 50


def test_same_rows_after_repartition(spark, skewed):
    once = sampling.split_exact(skewed, ["id"], 0.3)
    again = sampling.split_exact(skewed.repartition(13), ["id"], 0.3)
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.25, 1.0])
def test_split_sizes(spark, skewed, ratio):
    parts = sampling.split_exact(skewed, ["id"], ratio)
    counts = {(r["labels"], r["part"]): r["n"] for r in parts.groupBy("labels", "part").agg(F.count("*").alias("n")).collect()}
    for label, n in Counter(r[1] for r in SKEWED).items():
        assert counts.get((label, "test"), 0) == math.floor(n * ratio)
        assert counts.get((label, "train"), 0) == n - math.floor(n * ratio)
    test, train = parts.where("part = 'test'"), parts.where("part = 'train'")
    assert test.select("id").intersect(train.select("id")).isEmpty()


def test_sample_then_split(spark, skewed):
    parts = sampling.sample_and_split(skewed, ["id"], 50, 0.5)
    for label in {r[1] for r in SKEWED}:
        head = order(4711, label)[:50]
        test = ids(parts.where((F.col("labels") == label) & (F.col("part") == "test")))
        assert test == sorted(head[: len(head) // 2])
    assert parts.count() == sum(min(50, n) for n in Counter(r[1] for r in SKEWED).values())


def test_balance_respects_the_floor(spark, skewed):
    assert sampling.balance_and_split(skewed, ["id"], 0.2, "labels").count() == len(SKEWED)
    capped = sampling.balance_and_split(skewed, ["id"], 0.2, "labels", floor=5)
    assert set(Counter(r["labels"] for r in capped.collect()).values()) == {10}


def test_draws_with_replacement(spark, skewed):
    draws = sampling.sample_with_replacement(skewed, ["id"], 40, "labels")
    rows = draws.collect()
    assert Counter(r["labels"] for r in rows) == {label: 40 for label in {r[1] for r in SKEWED}}
    assert len({(r["labels"], r["draw"]) for r in rows}) == len(rows)
    assert max(Counter(r["id"] for r in rows if r["labels"] == "rare1").values()) > 1


def test_exact_share(spark, skewed):
    assert ids(sampling.sample_share(skewed, ["id"], 0.013)) == sorted(
        i for _, i in sorted((md5(f"9876:{i}".encode()).hexdigest(), i) for i, _ in SKEWED)[: math.ceil(7000 * 0.013)]
    )


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(1, 60), min_size=1, max_size=6), share=st.floats(0.05, 0.95))
def test_proportional_split(spark, sizes, share):
    rows = [(f"{c}-{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    parts = sampling.split_proportional(spark.createDataFrame(rows, "id string, label int"), ["id"], share)
    test = Counter(r["label"] for r in parts.where("part = 'test'").collect())
    want = math.ceil(len(rows) * share)
    assert sum(test.values()) == want
    assert all(abs(test.get(c, 0) - n * want / len(rows)) < 1 for c, n in enumerate(sizes))


def test_ratio_sweep_nests(spark, skewed):
    parts = sampling.split_ratios(skewed, ["id"], 40, [0.1, 0.5, 0.9])
    small, large = (ids(parts.where((F.col("ratio") == r) & (F.col("part") == "test"))) for r in (0.1, 0.9))
    assert set(small) < set(large)
    sampled = sum(min(40, n) for n in Counter(r[1] for r in SKEWED).values())
    assert Counter(r["ratio"] for r in parts.collect()) == {r: sampled for r in (0.1, 0.5, 0.9)}


def test_bernoulli_limits(spark):
    df = spark.range(20000).withColumn("h", hash_key(1, "id"))
    assert df.where(bernoulli(F.col("h"), 0)).count() == 0
    assert df.where(bernoulli(F.col("h"), 1)).count() == 20000
    assert abs(df.where(bernoulli(F.col("h"), 0.25)).count() - 5000) < 300


def test_shuffle_and_sort(spark, skewed):
    rows = [r["id"] for r in sampling.shuffled(skewed, ["id"], 3).collect()]
    assert rows == [i for _, i in sorted((md5(f"3:{i}".encode()).hexdigest(), i) for i, _ in SKEWED)]
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r[0] for r in sampling.sorted_by(df, "v", nulls="first").collect()] == [None, 1, 2]
    assert [r[0] for r in sampling.sorted_by(df, "v", reverse=True).collect()] == [2, 1, None]


def test_length_filters(spark):
    rows = [("many", n) for n in (1024, 1500, 100, 600)] + [("few", n) for n in (1024, 130, 100)] + [("none", 10)]
    df = spark.createDataFrame(rows, "labels string, feature_len int")
    kept = sorted(map(tuple, lengths.filter_two_tier(df, threshold=2).collect()))
    assert kept == [("few", 130), ("few", 1024), ("many", 1024), ("many", 1500)]
    chosen = dict(map(tuple, lengths.chosen_lengths(df, threshold=2).collect()))
    assert chosen == {"many": 1024, "few": 50}
    literal = dict(map(tuple, lengths.chosen_lengths(df, threshold=2, literal=True).collect()))
    assert literal == {"many": 1024}
    lost = lengths.lost_labels(df, lengths.filter_adaptive(df, threshold=2)).collect()
    assert [tuple(r) for r in lost] == [("none", 1)]


def test_job_writes_both_sides(spark, folder):
    rows = [(bytearray(bytes([i % 256, i // 256]) * (600 if i % 3 else 20)), 1200 if i % 3 else 40, "a" if i % 7 else "b") for i in range(2100)]
    df = spark.createDataFrame(rows, "x binary, feature_len long, labels string")
    df.write.parquet(f"{folder}/in/one.transformed.parquet")
    df.limit(0).write.parquet(f"{folder}/in/two.transformed.parquet")
    lost = train_test.run(spark, f"{folder}/in", f"{folder}/out", 1024, 150, 0.2)
    assert lost.count() == 0
    counts = {(r["labels"], r["part"]): r["count"] for r in spark.read.parquet(f"{folder}/out").groupBy("labels", "part").count().collect()}
    assert counts == {("a", "test"): 30, ("a", "train"): 120, ("b", "test"): 30, ("b", "train"): 120}
    df.withColumn("n", F.monotonically_increasing_id()).write.parquet(f"{folder}/ids/one.transformed.parquet")
    train_test.run(spark, f"{folder}/ids", f"{folder}/out2", None, 100, None, id_schema="n long")
    kept = spark.read.parquet(f"{folder}/out2")
    assert kept.columns == ["x", "feature_len", "labels", "n"] and kept.count() == 200
    train_test.few_shot(df.withColumn("id", F.sha2("x", 256)), ["id"], f"{folder}/sweep", [0.1, 0.5], 100)
    sweep = spark.read.parquet(f"{folder}/sweep").groupBy("ratio", "part", "labels").count().collect()
    assert {(r["ratio"], r["part"]): r["count"] for r in sweep if r["labels"] == "a"} == {
        (0.1, "test"): 10, (0.1, "train"): 90, (0.5, "test"): 50, (0.5, "train"): 50,
    }


def test_validation_only_if_missing(spark):
    df = spark.createDataFrame([(i, "train" if i < 50 else "extra", "t", i % 2) for i in range(60)], "id int, split string, dataset string, label int")
    members = Members(df)
    cut = members.with_validation(["id"], 0.2, "label")
    assert Counter(r["split"] for r in cut.df.collect()) == {"train": 40, "test": 10, "extra": 10}
    assert cut.with_validation(["id"], 0.5, "label") is cut
