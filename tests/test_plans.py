"""The same results when nothing may be broadcast, and plan shapes that matter at scale."""

from __future__ import annotations

import pytest

from __spark_entry__ import oracle_sql, queries
from packetloom.functions.hashing import hash_key
from packetloom.operators.stored import shared_dir, stored
from packetloom.operators.sampling import split_exact
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
JOINING = [
    "e1_under_sample", "e2_exact_split", "e3_sample_and_split", "e4_two_tier_length", "f4_with_replacement", "f6_few_shot_ratios",
    "f11_train_test_sets", "f3_sampled_flow_assembly", "c1_attach_label_count", "c5_template_match", "c6_label_lookup", "b11_large_units",
    "e10_time_slices", "e11_frames_and_streams", "d13_confusion_matrix", "d18_min_max_scaled", "a4_field_extraction",
]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", JOINING)
def test_without_broadcast(spark, no_broadcast, name):
    df = queries()[name](spark, SF_DIR)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert difference(name, df, connect(SF_DIR), oracle_sql()[name]) in (None, "(no rows)")


def test_pruned_scan(spark):
    df = queries()["c2_left_join_flag"](spark, SF_DIR)
    assert "ReadSchema: struct<doc_id:bigint>" in df._jdf.queryExecution().executedPlan().toString()
    plan = queries()["a8_parquet_columns"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,200000.0)]" in plan


def test_stored_tables_live_in_the_named_folder(spark):
    table = stored(spark.range(5).withColumn("h", hash_key(1, "id")))
    assert all(f.startswith(("file:" + shared_dir(spark), "file://" + shared_dir(spark))) for f in table.inputFiles())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_rows_stay_where_they_are_in_a_split(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = split_exact(docs, ["doc_id"], 0.2, "lang")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
