"""Exact duplicates: local winners, salted digest groups, then one winner among the salts; DataFrame operations only.

Two texts are equal when they are identical after every run of white space became one space. Digests only bring
texts together: at each stage the whole text is part of the grouping key, so that texts which share a digest
but differ never fall into one group, whatever the digest.

0. Digests are counted first, without texts. A text whose digest occurs once has no equal, and stays where it is.
   What keeps it there is a table of 2^20 buckets at most, those of the repeated digests, which is broadcast. Should it
   fill up, more texts move and the result is the same.
1. Every task combines the equal texts that it reads (the partial aggregation), so it sends one row for each,
   however many copies it has.
2. What the tasks send meets by (digest, salt, text). The salt is the task's number modulo ``salts``: copies of one
   text go to as many reducers as there are salts.
3. The winners of the salts meet by (digest, text).

Rows then learn their group by digest, in a join without texts; only digests that stand for several texts (none,
but for a digest of few bits) are joined by the text too. Groups with over 1/1024 of all rows are joined
by broadcast: there can be no more than 1024 of them. All others are small against the table, so the join
is even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept, text_of

SALTS = 32
HOT = 1024
BUCKETS = 1 << 20


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def sha256_of(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` of every row.

    ``keep_id`` is the smallest id among the equal texts, ``group_size`` how many rows have that text, ``kept``
    whether the row has the smallest id. Null texts count as empty ones, and all empty texts are equal; a text of
    white space only equals one space. Rows that repeat id and text are kept alike. A null id never wins over
    another; a group with null ids only keeps them. Other columns are not looked at, whatever
    their names. An empty table gives no rows.
    """
    content = normalised(F.col(text))
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    rows = kept(docs.select(F.col(doc_id).alias("id"), digest(content).alias("digest"), salt), "digests")
    repeated = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.sum("n").alias("n"))
    repeated = kept(repeated.where("n > 1").select("digest"), "repeated")

    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket")
    buckets = kept(repeated.select(bucket).distinct(), "repeated-buckets")
    texts = docs.select(F.col(doc_id).alias("id"), content.alias("content"), salt).withColumn("digest", digest(F.col("content")))
    texts = texts.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi")
    winners = texts.groupBy("digest", "salt", "content").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = kept(winners, "salt-winners").join(repeated, "digest", "left_semi")
    combined = kept(winners.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")), "winners")
    texts = combined.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")
    )
    one_text = F.when(F.col("texts") == 1, F.struct("keep_id", "n")).alias("group")
    groups = kept(texts.select("digest", one_text, F.lit(True).alias("known"), F.col("n").alias("rows")), "groups")

    is_hot = F.col("rows") * HOT > rows.count()
    hot, rest = kept(groups.where(is_hot).drop("rows"), "hot-groups"), groups.where(~is_hot).drop("rows")
    slim = rows.drop("salt")
    even = slim.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest", "left")
    found = slim.join(F.broadcast(hot), "digest").unionByName(even).where("known is null or group is not null")
    alone = F.struct(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    found = found.withColumn("group", F.coalesce("group", alone)).select("digest", "id", "group.keep_id", "group.n")
    clashing = kept(texts.where("texts > 1").select("digest"), "clashing")
    if not clashing.isEmpty():
        # Different texts with one digest: the text itself decides.
        whole = docs.select(F.col(doc_id).alias("id"), content.alias("content")).withColumn("digest", digest(F.col("content")))
        whole = whole.join(clashing, "digest", "left_semi").join(combined, ["digest", "content"])
        found = found.unionByName(whole.drop("content"))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text no row of a smaller id has."""
    drop = exact_groups(docs, doc_id, text).where("not kept")
    drop = kept(drop.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "dropped")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (sha256_of(normalised(F.col(text))) == F.col("__digest"))
    return docs.join(drop, same, "left_anti")
