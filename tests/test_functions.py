from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions import arrays, names, octets
from packetloom.functions.wide import unit_floats_arrow


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(1)
    data = [bytes(range(256)), b"", b"\x00", b"\xff" * 5, b"\n\r\x85", None] + [rng.randbytes(rng.randrange(2000)) for _ in range(60)]
    return spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(data)], "id int, b binary"), data


def test_every_byte_value(blobs):
    df, data = blobs
    got = {r["id"]: r["v"] for r in df.select("id", octets.byte_values(F.col("b")).alias("v")).collect()}
    assert got == {i: None if b is None else list(b) for i, b in enumerate(data)}


def test_crop_pad_and_floats(blobs):
    df, data = blobs
    b = F.col("b")
    rows = df.select(
        "id", octets.crop_and_pad(b, 300).alias("x"), octets.cropped_length(b, 300).alias("n"), arrays.unit_floats(b, 300).alias("f"),
        unit_floats_arrow(b, 300).alias("g"),
    ).where("b is not null").collect()
    for r in rows:
        want = (data[r["id"]] + bytes(300))[:300]
        assert bytes(r["x"]) == want and r["n"] == min(len(data[r["id"]]), 300)
        assert r["f"] == [v / 255 for v in want] == r["g"]


def test_hex(spark):
    assert bytes(value(spark, octets.from_hex(F.lit("abc"), "nibble"))) == b"\xab\x0c"
    assert bytes(value(spark, octets.from_hex(F.lit("a"), "nibble"))) == b"\x0a"
    assert bytes(value(spark, octets.from_hex(F.lit("00ff")))) == b"\x00\xff"
    with pytest.raises(Exception, match="odd number"):
        value(spark, octets.from_hex(F.lit("abc")))
    with pytest.raises(ValueError):
        octets.from_hex(F.lit("ab"), "other")
    assert value(spark, octets.hex_text(F.lit(b"\x00\xAB"))) == "00ab"
    assert bytes(value(spark, octets.overwrite_zero(F.lit(b"abcdef"), F.lit(2), 3))) == b"a\0\0\0ef"
    assert bytes(value(spark, octets.overwrite_zero(F.lit(b"abc"), F.lit(2), 3))) == b"abc"


def test_normalise_before_and_after_padding(spark):
    b = F.lit(bytes([0, 255] * 4))
    after = value(spark, arrays.normalised(b, 10, 0.5, 0.5, pad="after"))
    before = value(spark, arrays.normalised(b, 10, 0.5, 0.5))
    assert after == [-1.0, 1.0] * 4 + [0.0, 0.0] and before == [-1.0, 1.0] * 4 + [-1.0, -1.0]


def test_patches(spark):
    a = F.lit(list(range(12))).cast("array<double>")
    assert value(spark, arrays.patchify(a, 4, 3)) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert value(spark, arrays.unpatchify(arrays.patchify(a, 4, 3))) == list(range(12))
    assert value(spark, arrays.attention_mask(arrays.effective_patches(F.lit(65), 1024, 64), 4)) == [1, 1, 0, 0]
    assert value(spark, arrays.effective_patches(F.lit(5000), 1024, 64)) == 16
    assert value(spark, arrays.effective_patches(F.lit(0), 1024, 64)) == 0


def test_masking_is_a_permutation(spark):
    df = spark.range(50).select("id", *[c.alias(n) for c, n in zip(arrays.masking(1, ["id"], 4, 0.25), ("s", "r", "m"))])
    rows = df.collect()
    for r in rows:
        assert sorted(r["s"]) == [0, 1, 2, 3] and [r["s"][i] for i in r["r"]] == [0, 1, 2, 3]
        assert sum(r["m"]) == 1 and r["m"][r["s"][3]] == 1
    assert len({tuple(r["s"]) for r in rows}) > 10


def test_patch_targets_and_errors(spark):
    patches = F.lit([[1.0, 2.0, 3.0, 4.0], [5.0, 5.0, 5.0, 5.0]])
    got = value(spark, arrays.patch_targets(patches))
    scale = math.sqrt(5 / 3 + 1e-6)
    assert got[0] == pytest.approx([-1.5 / scale, -0.5 / scale, 0.5 / scale, 1.5 / scale]) and got[1] == [0, 0, 0, 0]
    zero = F.lit([[0.0] * 4, [4.0, 5.0, 6.0, 5.0]])
    assert value(spark, arrays.patch_errors(zero, patches)) == [7.5, 0.5]


def test_special_tokens_are_never_masked(spark):
    tokens, special = F.split(F.lit("a b c d e f g h i"), " "), F.lit([True] + [False] * 4 + [True] + [False] * 2 + [True])
    df = spark.range(400).select(arrays.mask_tokens(tokens, special, 1, ["id"], 0.15, "*").alias("t"))
    rows = [r["t"] for r in df.collect()]
    assert all(t[i] != "*" for t in rows for i in (0, 5, 8))
    assert abs(sum(t.count("*") for t in rows) / (400 * 6) - 0.15) < 0.03


def test_softmax_and_loss(spark):
    weights = value(spark, arrays.softmax(F.lit([0.1] * 4), F.lit([0.0, 0.0, 0.0, -1000.0])))
    assert weights == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0.0])
    loss = value(spark, arrays.cross_entropy(F.lit([1000.0, 1001.0]), F.lit(1)))
    assert loss == pytest.approx(math.log(1 + math.exp(-1)))
    assert value(spark, arrays.argmax(F.lit([1.0, 3.0, 3.0]))) == 1


def test_variance_of_one_value(spark):
    assert value(spark, arrays.sample_variance(F.lit([2.0]))) is None


def test_bind_evaluates_once_and_keeps_plans_small(spark):
    heavy = arrays.unit_floats(F.lit(b"abc"), 64)
    nested = arrays.softmax(arrays.softmax(arrays.softmax(heavy)))
    plan = spark.range(1).select(nested)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_names(spark):
    assert value(spark, names.clean_label(F.lit("web.a - b!"))) == "web_a_b_"
    assert value(spark, names.clean_stem(F.lit("größe-1.x y"))) == "größe_1.x_y"
    assert value(spark, names.class_name(F.lit("Mail.pcap.transformed"))) == "Mail"
    assert value(spark, names.file_stem(F.lit("/a/b/x.y.pcap"))) == "x.y"
    assert value(spark, names.file_stem(F.lit("/a/.hidden"))) == ".hidden"
    assert value(spark, names.directory_label(F.lit("/a/web.a/x.pcap"))) == "web.a"
    assert value(spark, names.relative_directory(F.lit("/a/b/c/x"), "/a")) == "b/c"
    assert value(spark, names.relative_directory(F.lit("/a/x"), "/a")) == "."
    assert value(spark, names.local_path(F.lit("file:///a/x%20y+z%25.csv"))) == "/a/x y+z%.csv"


def test_label_ids_leave_other_columns_alone(spark):
    from packetloom.operators.labels import label_mapping, with_label_id

    df = spark.createDataFrame([("a.b", "x"), ("c", "y")], "label string, labels string")
    by_label = {r["label"]: (r["labels"], r["label_id"]) for r in with_label_id(df, label_mapping(df, "label"), "label").collect()}
    assert by_label == {"a.b": ("x", 0), "c": ("y", 1)}
    by_labels = {r["label"]: r["label_id"] for r in with_label_id(df, label_mapping(df)).collect()}
    assert by_labels == {"a.b": 0, "c": 1}


def test_stems_keep_letters_and_numbers(spark):
    from packetloom.functions.names import clean_stem

    df = spark.createDataFrame([("x²",), ("e\u0301z",), ("a‿b",), ("a_b.c",)], "s string")
    assert [r[0] for r in df.select(clean_stem(F.col("s"))).collect()] == ["x²", "e_z", "a_b", "a_b.c"]


def test_null_ids_keep_their_place(spark):
    from packetloom.functions.hashing import hash_key

    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(hash_key(1, "x", "y", "z")).distinct().count() == 2
