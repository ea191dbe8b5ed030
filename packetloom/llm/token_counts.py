"""Token counts from pre-token counts: pieces of each distinct pre-token are counted once."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import blocks, buffers, kept, packed, parts_for, text_key, text_of, unpacked

# No piece of the model holds a space after another character or a newline beside another one, so
# merges never cross these borders. A newline is one byte piece.
PRE_TOKEN = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+")
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
_ENCODERS: dict = {}


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _encoder(path: str):
    if path not in _ENCODERS:
        import sentencepiece

        _ENCODERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _ENCODERS[path]


def count_pieces(path: str, words: list[str]) -> np.ndarray:
    """Pieces of each pre-token where it stands in a text.

    A leading newline keeps the encoder from putting a space before the word: two pieces less.
    """
    return np.array([len(x) for x in _encoder(path).encode(["\n" + w for w in words], num_threads=1)], np.int64) - 2


def _frequencies(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Per block of rows and bucket of pre-tokens: the pre-tokens, and (row, pre-token, times)."""
    schema = pa.schema([("block", pa.binary()), ("bucket", pa.int32()), ("words", pa.string()), ("rows", pa.binary()), ("refs", pa.binary()), ("times", pa.binary()), ("keys", pa.binary()), ("base", pa.binary()), ("pairs", pa.int64())])
    for batch in batches:
        texts, keys = batch.column("text"), batch.column("key").to_pylist()
        sizes = np.diff(buffers(texts)[1])
        for begin, end in blocks(sizes, BLOCK_BYTES):
            number, refs, times, owners, base = _Numbers(), [], [], [], []
            for i in range(begin, end):
                text = texts[i].as_py() or ""
                base.append(text.count("\n"))
                found = PRE_TOKEN.findall(" " + text) if text else []
                unique, n = np.unique(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), return_counts=True)
                refs.append(unique)
                times.append(n)
                owners.append(np.full(len(unique), i - begin))
            refs, times, owners = map(np.concatenate, (refs, times, owners))
            words = list(number)
            bucket = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in words), np.int64, len(words))
            block = hashlib.md5(b"".join(keys[begin:end])).digest()
            by_word = np.argsort(bucket, kind="stable")
            word_at = np.searchsorted(bucket[by_word], np.arange(n_buckets + 1))
            place = np.empty(len(words), np.int64)
            place[by_word] = np.arange(len(words)) - word_at[bucket[by_word]]
            owner = bucket[refs]
            by_pair = np.argsort(owner, kind="stable")
            pair_at = np.searchsorted(owner[by_pair], np.arange(n_buckets + 1))
            out = [(block, -1, None, None, None, None, b"".join(keys[begin:end]), packed(np.array(base)), len(refs))]
            for b in range(n_buckets):
                pick = by_pair[pair_at[b] : pair_at[b + 1]]
                if len(pick):
                    mine = "\n".join(words[w] for w in by_word[word_at[b] : word_at[b + 1]])
                    out.append((block, b, mine, packed(owners[pick]), packed(place[refs[pick]]), packed(times[pick]), None, None, len(pick)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _sums(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Tokens of each row of a block that come from one bucket's pre-tokens."""
    pieces: dict[str, int] = {}
    for batch in batches:
        out = []
        for block, bucket, words, rows, refs, times, keys, base, pairs in zip(*[c.to_pylist() for c in batch.columns]):
            if bucket >= 0:
                words = words.split("\n")
                new = [w for w in dict.fromkeys(words) if w not in pieces]
                pieces.update(zip(new, count_pieces(path, new).tolist()))
                each = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))
                sums = np.zeros(int(unpacked(rows).max()) + 1, np.int64)
                np.add.at(sums, unpacked(rows), each[unpacked(refs)] * unpacked(times))
                base = packed(sums)
            out.append((block, keys, base, pairs))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["block", "keys", "sums", "pairs"])


def _joined(table: pa.Table) -> pa.Table:
    """Tokens of each row of one block, from its sums over all buckets."""
    keys, sums, pairs = (table.column(c).to_pylist() for c in ("keys", "sums", "pairs"))
    heads = [i for i, k in enumerate(keys) if k is not None]
    n = len(keys[heads[0]]) // 16
    total, expected = np.zeros(n, np.int64), pairs[heads[0]] * len(heads)
    for data in sums:
        part = unpacked(data)
        total[: len(part)] += part
    if sum(pairs) - expected != expected:
        raise RuntimeError("a block of rows was read in another order when it was read again; run the job again")
    parts = [keys[heads[0]][16 * i : 16 * i + 16] for i in range(n)]
    return pa.table({"key": pa.array(parts, pa.binary()), "total": total, "copies": np.full(n, len(heads))})


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model`` is the path of a piece model whose file every executor has. Tasks cut texts into
    pre-tokens and pack, per block of rows and bucket of pre-tokens, the distinct pre-tokens and how
    often each row has each. One shuffle by bucket brings equal pre-tokens together: each is counted
    once, joined to the frequencies and summed per row; no ids are made. A block's sums come
    together by block, a bounded group.

    A null text counts as empty and has no tokens. Rows of equal text get equal counts, rows may
    repeat, any column may be null; columns of ``docs`` named like the new ones are replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(text_of(text).alias("text"), text_key(text).alias("key"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    n_buckets = parts_for(spark, n_bytes, BUCKET_BYTES)
    packs = rows.mapInArrow(lambda it: _frequencies(it, n_buckets), "block binary, bucket int, words string, rows binary, refs binary, times binary, keys binary, base binary, pairs long")
    sums = packs.repartition(n_buckets, "bucket", F.when(F.col("bucket") < 0, F.col("block"))).mapInArrow(lambda it: _sums(it, model), "block binary, keys binary, sums binary, pairs long")
    totals = sums.groupBy("block").applyInArrow(_joined, "key binary, total long, copies long")
    totals = totals.groupBy("key").agg((F.sum("total") / F.sum("copies")).cast("long").alias("n_tokens"))
    totals = kept(totals, "token_counts")
    new = ["n_bytes", "n_tokens", "over_limit"]
    left = docs.drop(*new).withColumns({"n_bytes": F.octet_length(text_of(text)).cast("long"), "__key": text_key(text)})
    right = totals.select(F.col("key").alias("__k"), "n_tokens")
    out = left.join(right, F.col("__key") == F.col("__k"), "left")
    return out.drop("__key", "__k").withColumn("over_limit", F.col("n_tokens") > limit)
