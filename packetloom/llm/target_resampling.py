"""Importance resampling towards a target text set, with weights from bit planes.

A text's features are its runs of one to three words, each hashed into a bucket. A bucket's gain is the log ratio of
its share in the target and in the corpus. A document's weight is the sum of the gains of its features. It is
computed without multiplying: the document's bucket counts are cut into planes of one bit per bucket (plane j holds
bit j of each count), the gains likewise, the highest plane carrying the sign; a plane of counts and one of gains
are joined by AND, the ones counted, and the counts added up with their powers of two. Weights are exact integers.

The CRC-32 of a run of words follows from those of its words, as CRCs are linear: appending a word multiplies by
a matrix that depends on its length only, which four table look-ups apply to a whole array. So every distinct
word of a block is hashed once.

Texts are read twice (corpus counts, then weights) and never shuffled. What is gathered is one count per bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.byte_words import LETTERS_AND_DIGITS, word_blocks
from packetloom.llm.common import kept
from packetloom.operators.ranking import numbered

BUCKETS = 10_000
ROWS = 128
POLYNOMIAL = 0xEDB88320


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32x32 bit matrix, given by what it makes of each bit, times many vectors of 32 bits."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(maxsize=4096)
def shift_table(length: int) -> np.ndarray:
    """What ``length`` more bytes do to the four bytes of a CRC: 4 x 256 values to be joined by XOR."""
    step = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    power = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while length:
        if length & 1:
            power = _apply(step, power)
        step = _apply(step, step)
        length >>= 1
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(power, byte << np.uint32(8 * k)) for k in range(4)])


def feature_codes(owner: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and CRC-32 of every run of one to three words of a row, joined by one space."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    words = words.to_pylist()
    bare = np.array([zlib.crc32(w) for w in words], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
    lengths, kind = np.unique(np.array([len(w) + 1 for w in words]), return_inverse=True)
    tables = np.stack([shift_table(int(n)) for n in lengths]).reshape(-1)
    kind = kind.astype(np.int64) << 10

    def appended(crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        base, out = kind[word], spaced[word]
        for k in range(4):
            out = out ^ tables[base + (k << 8) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
        return out

    single = bare[codes]
    double = appended(single[:-1], codes[1:])
    triple = appended(double[:-1], codes[2:])
    two, three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    return np.concatenate([owner, owner[:-1][two], owner[:-2][three]]), np.concatenate([single, double[two], triple[three]])


def bit_planes(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bits 0 to ``bits - 1`` of each row of numbers, a bit per number, in whole 64-bit words."""
    width = -(-values.shape[1] // 64) * 8
    for j in range(bits):
        plane = np.packbits((values >> j) & 1 == 1, axis=1)
        yield np.pad(plane, ((0, 0), (0, width - plane.shape[1]))).view(np.uint64)


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """Two's complement planes of signed gains, the last one that of the sign."""
    bits = max(int(np.abs(gains).max()), 1).bit_length() + 1
    return np.concatenate(list(bit_planes((gains & ((1 << bits) - 1))[None, :], bits)))


def plane_sums(counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sum of count times gain for each row of ``counts``; ``gains`` are planes."""
    total, top = np.zeros(len(counts), np.int64), len(gains) - 1
    for j, plane in enumerate(bit_planes(counts, int(counts.max(initial=0)).bit_length())):
        some = np.flatnonzero(plane.any(axis=1))
        plane = plane[some]
        for k, gain in enumerate(gains):
            ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (j + k)
            total[some] += -ones if k == top else ones
    return total


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all features of all texts; each task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, owner, codes, words in word_blocks(batch.column(0), LETTERS_AND_DIGITS):
                total += np.bincount(feature_codes(owner, codes, words)[1] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus), of every bucket.

    ``buckets`` numbers reach the driver, whatever the size of the corpus.
    """
    spark = corpus.sparkSession
    totals = [df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for df in (corpus, target)]
    both = (
        spark.range(buckets)
        .select(F.col("id").alias("bucket"))
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
    )
    s, t = (F.coalesce(c, F.lit(0)).cast("double") + 1.0 for c in ("s", "t"))
    ratio = (t * F.lit(float(totals[0] + buckets))) / (s * F.lit(float(totals[1] + buckets)))
    gains = np.zeros(buckets, np.int64)
    for row in both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        gains[row["bucket"]] = row["gain"]
    return gains


def with_weights(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""
    planes, buckets = gain_planes(gains), len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, owner, codes, words in word_blocks(batch.column(1), LETTERS_AND_DIGITS, ROWS):
                n = end - begin
                rows, crcs = feature_codes(owner, codes, words)
                counts = np.bincount(rows * buckets + crcs % np.uint32(buckets), minlength=n * buckets).reshape(n, buckets)
                counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, n),
                        pa.array(np.bincount(owner, minlength=n)),
                        pa.array(np.bincount(rows, minlength=n)),
                        pa.array(plane_sums(counts, planes)),
                    ],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a draw from the Gumbel distribution, rounded down, fixed by the seed and the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn: those with
    the highest ``score``, weight plus Gumbel noise, which draws without replacement in proportion to exp(weight / 1000).
    Equal scores go by the smaller id; a null id comes first and has the noise of an empty one. Rows that repeat
    an id have the same noise and are drawn each for itself. Null and empty texts have no features and weight 0.
    Other columns are not looked at. An empty target leaves the smoothed gains; an empty table gives no rows.
    """
    corpus = kept(bucket_counts(docs, text, buckets), "corpus-buckets")
    wanted = kept(bucket_counts(target, target_text, buckets), "target-buckets")
    weighed = with_weights(docs, bucket_gains(corpus, wanted, buckets), doc_id, text)
    scored = kept(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(), F.col("n_features").asc()])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
