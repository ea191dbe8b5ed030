"""Sampling and splitting; labels may be arbitrarily skewed.

Rows are identified by ``ids``. Rows that share an id count one by one all the same: sizes are exact
whatever the number of copies.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.hashing import bernoulli, hash_key, hash_number
from packetloom.operators.ranking import PIECE, hash_cut, hash_cuts, hash_rank, take, takes, with_cuts
from packetloom.operators.stored import attach, stored

# The sampling seed, and the class size below which classes are not cut.
SAMPLE_SEED = 9876
SPLIT_SEED = 4711
BALANCE_FLOOR = 10000


def label_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def _part(test: str = "_test") -> Column:
    return F.when(F.col(test), "test").otherwise("train")


def under_sample(df: DataFrame, ids: list[str], n: int, label: str = "labels", seed: int = SAMPLE_SEED) -> DataFrame:
    """At most ``n`` random rows of every label."""
    return hash_cut(df, [label], hash_key(seed, *ids), n)


def split_exact(df: DataFrame, ids: list[str], test_size: float, label: str = "labels", seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``part``: of every label the first ``floor(count * test_size)`` rows in hash order are test.

    Rows without a label are dropped.
    """
    df = df.where(F.col(label).isNotNull())
    h = hash_key(seed, *ids)
    cuts = hash_cuts(df, [label], h, take(F.floor(F.col("n_rows") * F.lit(float(test_size))), "_test"), ["_test"])
    return with_cuts(df, [label], h, cuts, ["_test"]).select(*df.columns, _part().alias("part"))


def sample_and_split(
    df: DataFrame, ids: list[str], n: int, test_size: float, label: str = "labels", seed: int = SPLIT_SEED
) -> DataFrame:
    """Cap every label at ``n`` rows and add ``part``: ``int(sample * test_size)`` rows are test."""
    df = df.where(F.col(label).isNotNull())
    h = hash_key(seed, *ids)
    sample = F.least(F.col("n_rows"), F.lit(n))
    test = F.floor(sample * F.lit(float(test_size)))
    names = ["_keep", "_test"]
    cuts = hash_cuts(df, [label], h, takes(_keep=sample, _test=test), names)
    return with_cuts(df, [label], h, cuts, names).where("_keep").select(*df.columns, _part().alias("part"))


def balance_and_split(
    df: DataFrame,
    ids: list[str],
    test_size: float,
    label: str = "label",
    seed: int = SAMPLE_SEED,
    split_seed: int = SPLIT_SEED,
    balance: bool = True,
    floor: int = BALANCE_FLOOR,
) -> DataFrame:
    """Cut every class to the smallest one (never below ``floor``), then draw test rows one by one.

    A row is test with probability ``test_size``; membership depends on its id alone, so both parts
    come from one pass.
    """
    if balance:

        def smallest(totals: DataFrame) -> DataFrame:
            least_rows = totals.agg(F.greatest(F.min("n_rows"), F.lit(floor)).alias("cap"))
            capped = totals.withColumn("k", F.lit(0)).join(least_rows.withColumn("k", F.lit(0)), "k")
            return capped.withColumn("cut", F.lit("_keep")).withColumn("n", F.least("n_rows", "cap"))

        h = hash_key(seed, *ids)
        cuts = hash_cuts(df, [label], h, smallest, ["_keep"])
        df = with_cuts(df, [label], h, cuts, ["_keep"]).where("_keep").drop("_keep")
    test = bernoulli(hash_key(split_seed, *ids), test_size)
    return df.withColumn("part", F.when(test, "test").otherwise("train"))


def sample_share(df: DataFrame, ids: list[str], ratio: float, seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``ceil(n * ratio)`` random rows of the whole table."""
    whole = df.withColumn("_all", F.lit(0))
    n = F.ceil(F.col("n_rows") * F.lit(float(ratio)))
    return hash_cut(whole, ["_all"], hash_key(seed, *ids), n).select(*df.columns)


def sample_rows(df: DataFrame, ids: list[str], n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """Shuffle with a seed and take the first ``n`` rows."""
    whole = df.withColumn("_all", F.lit(0))
    return hash_cut(whole, ["_all"], hash_key(seed, *ids), n).select(*df.columns)


def sample_flows(
    packets: DataFrame, file: str, stream: str, share: int = 32, seed: int = SAMPLE_SEED
) -> DataFrame:
    """The packets of ``floor(flows / share)`` random flows of every file.

    Applied before assembly, so that the payloads of other flows are never moved: the choice is a
    threshold per file on a hash of the flow key, which every packet carries.
    """
    h = hash_key(seed, file, stream)
    flows = stored(packets.select(file, stream).distinct(), "flows")
    cuts = hash_cuts(flows, [file], h, take(F.floor(F.col("n_rows") / share), "_keep"), ["_keep"])
    return with_cuts(packets, [file], h, cuts, ["_keep"]).where("_keep").select(*packets.columns)


def sample_with_replacement(
    df: DataFrame, ids: list[str], n: int, label: str = "label", seed: int = SAMPLE_SEED
) -> DataFrame:
    """``n`` draws from every label, each row as often as it is drawn; ``draw`` numbers them.

    A draw is a hash reduced modulo the class size; rows are numbered in hash order, of which only
    label, id and number move, and the wide rows are fetched by id, which must be unique. Draws are made in runs of
    10 000, which are dealt to tasks before they are written out, so that no task makes all of a label's.
    """
    df = df.where(F.col(label).isNotNull())
    ranked = hash_rank(df.select(label, *ids), [label], hash_key(seed, *ids))
    sizes = stored(label_sizes(df, label), "label-sizes")
    runs = sizes.withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(n), F.lit(PIECE)))) if n > 0 else sizes.limit(0).withColumn("_first", F.lit(1))
    # A counted repartition is not merged by adaptive execution: runs are small rows that grow when written out.
    runs = runs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), label, "_first")
    last = F.least(F.col("_first") + (PIECE - 1), F.lit(n))
    draws = (
        runs.withColumn("draw", F.explode(F.sequence("_first", last)))
        .withColumn("rank", hash_number(hash_key(seed, label, "draw")) % F.col("n_rows") + 1)
        .select(label, "draw", "rank")
    )
    picked = stored(ranked.join(draws, [label, "rank"]).select(*ids, "draw"), "draws")
    return attach(df, picked, ids)


def split_proportional(
    df: DataFrame, ids: list[str], test_size: float, label: str = "label", seed: int = SPLIT_SEED
) -> DataFrame:
    """Stratified split with exactly ``ceil(n * test_size)`` test rows overall.

    Every class gets its proportional share rounded down; what is left goes to the largest
    fractional parts, ties to the smaller label.
    """
    df = df.where(F.col(label).isNotNull())

    def largest_remainder(totals: DataFrame) -> DataFrame:
        everything = Window.partitionBy()
        want = F.ceil(F.sum("n_rows").over(everything) * F.lit(float(test_size)))
        shares = totals.withColumn("want", want).withColumn("total", F.sum("n_rows").over(everything))
        wide = "decimal(19,0)"
        shares = shares.withColumn("product", F.col("n_rows").cast(wide) * F.col("want").cast(wide))
        shares = shares.withColumn("base", ((F.col("product") - F.col("product") % F.col("total")) / F.col("total")).cast("long"))
        shares = shares.withColumn("rest", F.col("product") % F.col("total"))
        place = F.row_number().over(everything.orderBy(F.col("rest").desc(), F.col(label)))
        left = F.col("want") - F.sum("base").over(everything)
        extra = F.when(place <= left, 1).otherwise(0)
        return shares.withColumn("n", F.col("base") + extra).withColumn("cut", F.lit("_test"))

    h = hash_key(seed, *ids)
    cuts = hash_cuts(df, [label], h, largest_remainder, ["_test"])
    return with_cuts(df, [label], h, cuts, ["_test"]).select(*df.columns, _part().alias("part"))


def missing_classes(parts: DataFrame, label: str = "label") -> DataFrame:
    """Classes that one side of a split lacks: ``label, n_train, n_test``."""
    sides = parts.groupBy(label).agg(
        F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test")
    )
    return sides.where((F.col("n_train") == 0) | (F.col("n_test") == 0))


def warn_missing_classes(parts: DataFrame, label: str = "label") -> None:
    if not missing_classes(parts, label).isEmpty():
        warnings.warn("train and test do not hold the same classes", stacklevel=2)


def split_ratios(
    df: DataFrame,
    ids: list[str],
    n: int,
    ratios: list[float],
    label: str = "labels",
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Few-shot sweep: cap every label at ``n`` rows, then one train/test split per ratio.

    All splits are thresholds on one order, found in one pass; each sampled row appears once per
    ratio, with ``ratio`` and ``part``.
    """
    df = df.where(F.col(label).isNotNull())
    h = hash_key(seed, *ids)
    sample = F.least(F.col("n_rows"), F.lit(n))
    tests = {f"_t{i}": F.floor(sample * F.lit(float(r))) for i, r in enumerate(ratios)}
    names = ["_keep", *tests]
    cuts = hash_cuts(df, [label], h, takes(_keep=sample, **tests), names)
    kept = with_cuts(df, [label], h, cuts, names).where("_keep")
    options = F.array(
        *[
            F.struct(F.lit(float(r)).alias("ratio"), _part(f"_t{i}").alias("part"))
            for i, r in enumerate(ratios)
        ]
    )
    return kept.withColumn("_o", F.explode(options)).select(*df.columns, "_o.ratio", "_o.part")


def shuffle_rank(df: DataFrame, ids: list[str], seed: int, name: str = "position") -> DataFrame:
    """The position of every row in a seeded shuffle of the table, from 1."""
    return hash_rank(df.withColumn("_all", F.lit(0)), ["_all"], hash_key(seed, *ids), name).drop("_all")


def shuffled(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """Rows in seeded random order; a range-partitioned sort, so the order is global."""
    return df.withColumn("_h", hash_key(seed, *ids)).orderBy("_h").drop("_h")


def sorted_by(df: DataFrame, column: str, reverse: bool = False, nulls: str = "last") -> DataFrame:
    """Rows in the order of a column."""
    c = F.col(column)
    orders = {
        (False, "last"): c.asc_nulls_last,
        (False, "first"): c.asc_nulls_first,
        (True, "last"): c.desc_nulls_last,
        (True, "first"): c.desc_nulls_first,
    }
    if (reverse, nulls) not in orders:
        raise ValueError("nulls must be 'first' or 'last'")
    return df.orderBy(orders[reverse, nulls]())
