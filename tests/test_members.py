from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators.members import Members, flatten_structs
from packetloom.sources import tables


@pytest.fixture(scope="module")
def members(spark):
    def table(lo, hi):
        return spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(lo, hi)], "id long, text string, label int")

    return Members.of({"train": {"a": table(0, 10), "b": table(10, 25)}, "test": {"a": table(25, 30)}})


def test_shape(members):
    assert members.column_names == ["id", "text", "label"] and members.num_columns == 3
    assert {(r["split"], r["dataset"]): r["num_rows"] for r in members.num_rows().collect()} == {("train", "a"): 10, ("train", "b"): 15, ("test", "a"): 5}
    assert members.unique("label").count() == 9
    assert "text" in repr(members)


def test_selection(members):
    assert members["train"].df.count() == 25 and members.table("train", "b").columns == ["id", "text", "label"]
    with pytest.raises(KeyError, match="choose one of .*test.*train"):
        members["nope"]
    with pytest.raises(KeyError):
        members[0]
    with pytest.raises(TypeError):
        Members.of({"train": {"a": [1, 2]}})
    with pytest.raises(TypeError):
        Members(members.table("train", "a"))


def test_columns(members):
    assert members.rename_column("text", "body").column_names == ["id", "body", "label"]
    assert members.remove_columns(["text"]).column_names == ["id", "label"]
    assert dict(members.cast({"id": "int", "text": "string", "label": "long"}).df.dtypes)["label"] == "bigint"
    for wrong in (
        lambda: members.rename_column("none", "x"),
        lambda: members.rename_column("text", "id"),
        lambda: members.remove_columns("none"),
        lambda: members.cast({"id": "int"}),
        lambda: members.cast_column("none", "int"),
        lambda: members.select_columns(["none"]),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_map(members):
    doubled = members.map(lambda b: b[["id"]] * 2, "id long", ["id"], remove_columns=["text"], batch_size=4)
    assert doubled.column_names == ["label", "id"] and sorted(r["id"] for r in doubled.df.collect()) == [2 * i for i in range(30)]
    ranked = members.map(lambda b: b.assign(part=b["rank"])[["part"]], "part int", ["id"], with_rank=True)
    assert {r["part"] for r in ranked.df.collect()} <= set(range(100))
    whole = Members(members.df.coalesce(1)).map(lambda b, by: b[["id"]] + by, "id long", ["id"], batch_size=7, drop_last_batch=True, by=1)
    assert whole.df.count() == 28
    several = members.map(lambda b: b[["id"]].loc[b.index.repeat(2)], "id long", ["id"], remove_columns=["text", "label"])
    assert several.df.count() == 60 and several["test"].df.count() == 10
    with pytest.raises(Exception, match="number of rows"):
        members.map(lambda b: b[["id"]].head(1), "id long", ["id"]).df.collect()


def test_map_members(members):
    sums = members.map_members(lambda g: pd.DataFrame({"total": [g["id"].sum()]}), "total long")
    assert {(r["split"], r["dataset"]): r["total"] for r in sums.df.collect()} == {("train", "a"): 45, ("train", "b"): sum(range(10, 25)), ("test", "a"): 135}


def test_filter_and_order(members):
    assert members.filter(F.col("id") > 20).filter(lambda b: b["label"] == 0).df.count() == 3
    rows = [(r["split"], r["dataset"], r["id"]) for r in members.sort("id", reverse=True).df.collect()]
    assert rows == sorted(rows, key=lambda r: (r[0], r[1], -r[2]))
    one, two = ([r["id"] for r in members.shuffle(["id"], seed=s).df.collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) == list(range(30)) and one != two
    mixed = [r["id"] for r in members.shuffle(["id"], seeds={"train": 1, "test": 2}).df.collect()]
    assert mixed[:5] == two[:5] and mixed[5:] == one[5:]
    for seeds in ({}, {"seed": 1, "seeds": {"train": 1}}):
        with pytest.raises(ValueError):
            members.shuffle(["id"], **seeds)


def test_save_and_load(spark, members, folder):
    members.save(folder + "/m")
    again = Members.load(spark, folder + "/m")
    assert again.splits() == ["test", "train"]
    assert again.df.select(*members.df.columns).exceptAll(members.df).isEmpty() and again.df.count() == 30
    plan = again["train"].df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(FileNotFoundError):
        Members.load(spark, folder + "/none")
    spark.createDataFrame([("other", ["x"])], "kind string, splits array<string>").write.json(folder + "/o/manifest")
    with pytest.raises(FileNotFoundError):
        Members.load(spark, folder + "/o")


def test_names_that_look_like_numbers(spark, folder):
    df = spark.createDataFrame([(1, "001", "2024-01-01"), (2, "1", "x y")], "id int, split string, dataset string")
    Members(df).save(folder + "/n")
    again = Members.load(spark, folder + "/n")
    assert sorted((r["id"], r["split"], r["dataset"]) for r in again.df.collect()) == [(1, "001", "2024-01-01"), (2, "1", "x y")]


def test_collapse(members):
    assert {r["path"] for r in members.as_paths().collect()} == {"train/a", "train/b", "test/a"}
    assert set(members.as_splits().columns) == {"id", "text", "label", "split"}


def test_flatten(spark):
    df = spark.sql("select 1 as k, struct(2 as a, struct(3 as c) as b) as s")
    assert flatten_structs(df).columns == ["k", "s.a", "s.b.c"]
    assert flatten_structs(df, 1).columns == ["k", "s.a", "s.b"]
    assert tuple(flatten_structs(df).first()) == (1, 2, 3)


def test_encode_and_align(spark, members):
    coded, mapping = members.encode_classes("text")
    assert mapping.count() == 30 and dict(coded.df.dtypes)["text"] == "int"
    names = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "label_id int, label string")
    target = spark.createDataFrame([("c", 7), ("b", 8), ("a", 9)], "label string, label_id int")
    assert {(r["id"] % 3, r["label"]) for r in members.align_labels(names, target, "label").df.collect()} == {(0, 9), (1, 8), (2, 7)}


def test_task(spark):
    df = spark.createDataFrame([(bytearray(b"x"), "a", 1, "train", "d")], "x binary, labels string, other int, split string, dataset string")
    assert Members(df).prepare_for_task("classification").column_names == ["pixel_values", "labels"]


def test_files(spark, folder):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    df.coalesce(1).write.option("header", True).csv(folder + "/csv/one")
    df.coalesce(1).write.option("compression", "gzip").json(folder + "/json/one")
    df.coalesce(1).write.parquet(folder + "/parquet/one")
    df.select("text").coalesce(1).write.text(folder + "/text/one")
    for m in (
        Members.from_csv(spark, folder + "/csv", "id long, text string"),
        Members.from_json(spark, folder + "/json", "id long, text string"),
        Members.from_parquet(spark, folder + "/parquet", "id long, text string"),
    ):
        assert sorted((r["split"], r["id"], r["text"]) for r in m.df.collect()) == [("one", 1, "x"), ("one", 2, "y")]
    assert Members.from_parquet(spark, folder + "/parquet", columns=["id"]).column_names == ["id"]
    assert sorted(r["value"] for r in Members.from_text(spark, folder + "/text").df.collect()) == ["x", "y"]


def test_malformed_lines(spark, folder):
    import os

    os.makedirs(folder + "/c")
    with open(folder + "/c/x.csv", "w") as f:
        f.write("a,b\n1,x\n\n7,too,many\n8\n2,z\n")
    read = tables.read_csv(spark, folder + "/c", "a int, b string", file_column="file")
    assert sorted(r["a"] for r in read.collect()) == [1, 2] and read.count() == 2
    assert [r["b"] for r in read.select("b").orderBy("b").collect()] == ["x", "z"]
    assert {r["file"] for r in read.collect()} == {folder + "/c/x.csv"}
    os.makedirs(folder + "/d")
    with open(folder + "/d/x.csv", "w") as f:
        f.write("a,b\nbad,x\n3,y\n")
    assert [r["a"] for r in tables.read_csv(spark, folder + "/d", "a int, b string").collect()] == [3]
    with open(folder + "/c/t.tsv", "w") as f:
        f.write("label\ttext_a\n3\t00ff\n")
    row = tables.burst_rows(tables.read_templates(spark, folder + "/c/t.tsv")).first()
    assert (bytes(row["burst"]), row["len"], row["label"]) == (b"\x00\xff", 2, 3)


def test_indices(spark):
    rows = [(i, "train" if i % 3 else "test", "a" if i % 2 else None) for i in range(60)]
    members = Members(spark.createDataFrame(rows, "id int, split string, dataset string").repartition(5))
    place = {}
    for i, split, dataset in rows:
        place[i] = sum(1 for j, s, d in rows if (s, d) == (split, dataset) and j < i)
    kept = members.filter(lambda b: b["index"] % 2 == 0, with_indices=["id"])
    assert kept.df.columns == members.df.columns
    assert {r["id"] for r in kept.df.collect()} == {i for i in place if place[i] % 2 == 0}
    by_column = members.filter(F.col("index") < 3, with_indices=["id"])
    assert {r["id"] for r in by_column.df.collect()} == {i for i in place if place[i] < 3}
    seen = members.filter(lambda b, least: (b["id"] >= least) & (list(b.columns) == ["id"]), input_columns=["id"], least=50)
    assert {r["id"] for r in seen.df.collect()} == set(range(50, 60))
    made = members.map(lambda b: (b["index"] * 100 + b["id"]).to_frame("code"), "code long", ["id"], with_indices=["id"])
    assert {r["id"]: r["code"] for r in made.df.collect()} == {i: place[i] * 100 + i for i in place}
    with pytest.raises(ValueError):
        members.filter(lambda b: b["id"] > 0, with_indices=["none"])
    with pytest.raises(ValueError):
        Members(members.df.withColumn("index", F.lit(1))).filter(lambda b: b["id"] > 0, with_indices=["id"])


def test_a_save_that_breaks_off_leaves_the_old_dataset(spark, members, folder, monkeypatch):
    from packetloom.operators import members as module

    path = folder + "/m"
    members.save(path)
    less = Members(members.df.where("id < 5"))
    n = less.df.count()

    def stop(*args):
        raise OSError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(module, "_switch", stop)
        with pytest.raises(OSError):
            less.save(path)
    assert Members.load(spark, path).df.count() == 30
    # Between the two moves there is the new manifest only.
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path + "/manifest")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    assert Members.load(spark, path).df.count() == n
    members.save(path)
    assert Members.load(spark, path).df.count() == 30
    assert len([f for f in __import__("os").listdir(path) if f.startswith("data")]) == 1


def test_files_of_saved_members_are_bounded(spark, folder):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4500, "big").otherwise("small").alias("dataset"), F.lit("s").alias("split"))
    Members(df.repartition(9)).save(folder + "/b", rows_per_file=1000)
    files = Members.load(spark, folder + "/b").df.groupBy("dataset", F.input_file_name().alias("f")).count().collect()
    sizes = {d: [r["count"] for r in files if r["dataset"] == d] for d in ("big", "small")}
    assert max(sizes["big"]) <= 2000 and 4 <= len(sizes["big"]) <= 8 and sizes["small"] == [500]


def test_groups_too_large_for_a_task_are_refused(members):
    with pytest.raises(ValueError, match="train/b has 15 rows"):
        members.map_members(lambda g: g[["id"]], "id long", most_rows=14)
    assert members.map_members(lambda g: g[["id"]], "id long", most_rows=15).df.count() == 30
