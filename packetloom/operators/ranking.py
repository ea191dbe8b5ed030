"""Exact random order inside a key without sorting the key in one task.

Classes are few and one of them may hold most rows, so ``row_number`` over a class would put it
into one task. Here the hash space is cut into 65 536 buckets: counts per (key, bucket) are
partially aggregated before the shuffle, and their running sum, over the small count table, says
which single bucket of each key holds the n-th row. Of that bucket the hashes are counted, again
with partial aggregation, and the counts put in order. What remains for the wide rows is a comparison with one
threshold per key: no payload is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.stored import attach, stored

BUCKET_DIGITS = 4

# Copies written out by one piece.
PIECE = 10_000


def _bucket() -> Column:
    return F.substring(F.col("_h"), 1, BUCKET_DIGITS)


def bucket_sizes(slim: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """``keys, _b, _c, _before``: rows per bucket, and rows of the key in earlier buckets."""
    counts = slim.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    running = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b"))
    return counts.withColumn("_before", running - F.col("_c"))


def hash_cuts(
    df: DataFrame,
    keys: list[str],
    h: Column,
    allocate: Callable[[DataFrame], DataFrame],
    names: list[str],
) -> DataFrame:
    """Where each named cut falls in the hash order of every key.

    ``allocate`` receives ``(keys, n_rows)`` and returns ``(keys, cut, n)``: how many rows of the
    key each cut takes. The result has ``keys`` and per name a struct ``(h, r, c)``: the hash of
    the n-th row, how many of the rows with that hash are inside, and how many there are. It is
    null for a cut of no rows.

    The rows are read once: their keys and hashes are written down, and both searches, for the bucket and for the
    place inside it, read those.
    """
    slim = stored(df.select(*keys, h.alias("_h")), "hashes")
    sizes = stored(bucket_sizes(slim, keys, _bucket()), "bucket-sizes")
    totals = sizes.groupBy(*keys).agg(F.sum("_c").alias("n_rows"))
    cuts = allocate(totals).select(*keys, "cut", F.col("n").cast("long").alias("n"))
    marks = (
        attach(sizes, cuts, keys)
        .where((F.col("_before") < F.col("n")) & (F.col("n") <= F.col("_before") + F.col("_c")))
        .select(*keys, "_b", "cut", (F.col("n") - F.col("_before")).alias("_n"))
    )
    marks = stored(marks, "cut-buckets")
    copies = attach(slim.withColumn("_b", _bucket()), marks, [*keys, "_b"]).groupBy(*keys, "cut", "_n", "_h")
    copies = copies.agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "cut").orderBy("_h"))
    copies = copies.withColumn("_r", F.col("_n") - upto + F.col("_c"))
    found = copies.where((F.col("_r") > 0) & (F.col("_r") <= F.col("_c")))
    at = F.struct(F.col("_h").alias("h"), F.col("_r").alias("r"), F.col("_c").alias("c"))
    return stored(found.groupBy(*keys).agg(*[F.max(F.when(F.col("cut") == n, at)).alias(n) for n in names]), "cuts")


def with_cuts(df: DataFrame, keys: list[str], h: Column, cuts: DataFrame, names: list[str]) -> DataFrame:
    """Rows with one boolean per cut of :func:`hash_cuts`, true inside it.

    Rows with equal hashes, that is with equal ids, are copies. A cut through a group of copies
    takes as many of them as are due: such groups, and no other rows, are counted by content and
    written out again in bounded pieces, however many copies there are.
    """
    joined = attach(df.withColumn("_h", h), cuts, keys, "left")
    inside = {
        name: F.coalesce((F.col("_h") < F.col(name)["h"]) | ((F.col("_h") == F.col(name)["h"]) & (F.col(name)["r"] == F.col(name)["c"])), F.lit(False))
        for name in names
    }
    through = F.lit(False)
    for name in names:
        through = through | F.coalesce(F.col(name)["r"] < F.col(name)["c"], F.lit(False))
    if cuts.where(through).isEmpty():
        return joined.select(*df.columns, *[c.alias(name) for name, c in inside.items()])

    at_cut = F.lit(False)
    for name in names:
        at_cut = at_cut | F.coalesce((F.col("_h") == F.col(name)["h"]) & (F.col(name)["r"] < F.col(name)["c"]), F.lit(False))
    whole = joined.where(~at_cut).select(*df.columns, *[c.alias(name) for name, c in inside.items()])
    groups = joined.where(at_cut).groupBy(*df.columns, "_h", *names).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys, "_h").orderBy(*[c for c in df.columns if c not in keys])
    groups = groups.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    pieces = groups.withColumn("_p", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / PIECE))))
    # A counted repartition is not merged by adaptive execution: pieces are small rows that grow when written out.
    pieces = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h", "_p")
    places = F.sequence(F.lit(1), F.least(F.lit(PIECE), F.col("_n") - F.col("_p") * PIECE).cast("int"))
    rows = pieces.withColumn("_i", F.explode(places)).withColumn("_i", F.col("_before") + F.col("_p") * PIECE + F.col("_i"))
    parts = {
        name: F.when(F.col("_h") == F.col(name)["h"], F.col("_i") <= F.col(name)["r"]).otherwise(inside[name]) for name in names
    }
    return whole.union(rows.select(*df.columns, *[c.alias(name) for name, c in parts.items()]))


def take(n: Column | int, cut: str = "keep") -> Callable[[DataFrame], DataFrame]:
    """Allocation of at most ``n`` rows per key; ``n`` may use ``n_rows``."""
    n = F.lit(n) if isinstance(n, int) else n
    return lambda totals: totals.withColumn("cut", F.lit(cut)).withColumn("n", F.least(F.col("n_rows"), n))


def takes(**cuts: Column) -> Callable[[DataFrame], DataFrame]:
    """Several named cuts of the same order, each an expression of ``n_rows``."""
    entries = F.array(*[F.struct(F.lit(name).alias("cut"), n.cast("long").alias("n")) for name, n in cuts.items()])
    return lambda totals: totals.withColumn("e", F.explode(entries)).select("*", "e.cut", "e.n").drop("e")


def hash_cut(df: DataFrame, keys: list[str], h: Column, n: Column | int) -> DataFrame:
    """The first ``n`` rows of every key in hash order."""
    cuts = hash_cuts(df, keys, h, take(n, "_keep"), ["_keep"])
    return with_cuts(df, keys, h, cuts, ["_keep"]).where("_keep").select(*df.columns)


def bucketed_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """``row_number`` over ``keys`` in the given order, sorted bucket by bucket.

    ``bucket`` must never decrease along the order, and be fine enough that one task can sort a
    bucket of one key. The work of one key spreads over its buckets.
    """
    tagged = df.withColumn("_b", bucket)
    sizes = stored(bucket_sizes(tagged, keys, F.col("_b")), "bucket-sizes").drop("_c")
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    ranked = attach(tagged, sizes, [*keys, "_b"])
    return ranked.withColumn(name, (F.col("_before") + within).cast("long")).drop("_b", "_before")


def hash_rank(df: DataFrame, keys: list[str], h: Column, name: str = "rank") -> DataFrame:
    """The rank of every row inside its key in hash order."""
    ranked = bucketed_rank(df.withColumn("_h", h), keys, [F.col("_h")], _bucket(), name)
    return ranked.drop("_h")


def _ranged(df: DataFrame, order: list[Column]) -> tuple[DataFrame, Column]:
    """``df`` written in the given order, a range to a task, with ``_before`` and the place of each row from 0."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")
    offsets = stored(sizes.select("_task", before.alias("_before")), "offsets")
    return rows.join(offsets, task == F.col("_task")), F.col("_before") + place


def numbered(df: DataFrame, order: list[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """``df`` with a running number from ``start`` in the given order, without a window over all rows.

    Rows are dealt to tasks by ranges of the order, sorted inside each, and numbered there; the sizes of the
    ranges, one row per task, give the offset of each. ``df`` is read twice (its order is sampled first):
    store it if it is costly. Rows that the order can't tell apart are numbered in any order, and share a range:
    add an id to the order where many may be equal.
    """
    rows, place = _ranged(df, order)
    return rows.select(*df.columns, (place + start).alias(name))


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Like :func:`numbered`, from ``start`` again in every key; one key may hold most rows."""
    rows, place = _ranged(df, [*[F.col(k).asc() for k in keys], *order])
    rows = rows.withColumn("_place", place)
    first = stored(rows.groupBy(*keys).agg(F.min("_place").alias("_first")), "first-places")
    return attach(rows, first, keys).select(*df.columns, (F.col("_place") - F.col("_first") + start).alias(name))
