"""Byte-level BPE with content-defined chunks: a chunk that documents share is encoded once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept, lean, rows_of, step_conf, text_of

WINDOW_BITS = 5  # the rolling hash looks at 32 bytes
CHUNK_BITS = 10  # chunks of about 1024 bytes
LEAST = 128
FILTER_BITS = 1 << 25  # of the shared chunks' filter, whatever the input
SENT = 1 << 16  # chunks that a task remembers to have sent
GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_CODERS: dict[str, Coder] = {}


def cuts(data: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end. Cuts depend on 32 bytes of content and stand before characters."""
    n = len(data)
    rolled = GEAR[data]
    for bit in range(WINDOW_BITS):
        step = 1 << bit
        if n > step:
            rolled[step:] += rolled[:-step].copy() << np.uint32(step)
    at = np.flatnonzero((rolled >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    out, last = [0], 0
    for i in at.tolist():
        while i < n and data[i] & 0xC0 == 0x80:
            i += 1
        if i - last >= LEAST and n - i >= LEAST:
            out.append(last := i)
    return np.array([*out, n])


def joints(data: np.ndarray) -> np.ndarray:
    """Places where an encoding never depends on what stands on the other side.

    A space after a visible ASCII character: pre-tokens hold a space only as their first character
    or among white space alone, so one ends before it, and none looks back.
    """
    return np.flatnonzero((data[1:] == 0x20) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1


class Coder:
    """Encodes and decodes as the tokenizers library does with the same file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = about["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in about["added_tokens"]}
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        ranks = {b: i for i, b in self.bytes.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in about["model"]["merges"]]
        if made != sorted(made) or about.get("normalizer") or len(self.special) > 1:
            raise ValueError("not a plain byte-level vocabulary numbered by its merges")
        import public_tokenizers
        import tiktoken

        self.core = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special strings in it get their id, as is the library's default."""
        for word, number in self.special.items():
            if word in text:
                parts = [self.core.encode_to_numpy(p) for p in text.split(word)]
                between = [x for p in parts for x in (np.array([number], np.uint32), p)][1:]
                return np.concatenate(between)
        return self.core.encode_to_numpy(text)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _bit(key: bytes) -> int:
    return int.from_bytes(key[:8], "little") % FILTER_BITS


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text").cast(pa.large_binary()):
            data = text.as_py()
            at = cuts(np.frombuffer(data, np.uint8)).tolist()
            found += [_key(data[a:b]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["key"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[[_bit(k) for k in batch.column("key").to_pylist()]] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


_DONE = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
_PIECES = f"row long, doc_id long, seq int, key binary, text binary, part binary, {_DONE}"


def _finished(coder: Coder, ids: np.ndarray, with_ids: bool) -> tuple:
    raw = ids.astype("<u4").tobytes()
    decoded = coder.decode(ids).encode()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest(), raw if with_ids else None


def _pieces(batches: Iterator[pa.RecordBatch], path: str, shared: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Texts without shared chunks encoded whole; else stretches between and references to chunks' inner parts.

    A chunk's inner part runs from its first to its last joint. Around it the text is encoded anew, so
    that the pieces are what the whole text's encoding has there.
    """
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _PIECES.split(", ")]
    code = coder(path)
    sent: set[bytes] = set()
    for batch in batches:
        out, size = [], 0
        if len(sent) > SENT:
            sent.clear()
        for row, doc_id, text in zip(*[batch.column(c) for c in ("row", "doc_id", "text")]):
            row, doc_id, data = row.as_py(), doc_id.as_py(), text.cast(pa.large_binary()).as_py()
            view = np.frombuffer(data, np.uint8)
            safe, at = joints(view), cuts(view).tolist()
            inner = []
            for a, b in zip(at, at[1:]):
                lo, hi = np.searchsorted(safe, a + 1), np.searchsorted(safe, b - 1, "right") - 1
                if hi > lo and shared[_bit(key := _key(data[a:b])) >> 3] & (0x80 >> (_bit(key) & 7)):
                    inner.append((int(safe[lo]), int(safe[hi]), key))
            if not inner:
                out.append((row, doc_id, None, None, None, None, *_finished(code, code.encode(data.decode()), with_ids)))
                size += len(out[-1][-1] or b"")
            done = 0
            for n, (a, b, key) in enumerate(inner):
                ids = code.encode(data[done:a].decode()).astype("<u4").tobytes()
                out.append((row, doc_id, 2 * n, None, None, ids, None, None, None, None))
                chunk = None if key in sent else data[a:b]
                sent.add(key)
                out.append((row, doc_id, 2 * n + 1, key, chunk, None, None, None, None, None))
                size, done = size + len(ids) + len(chunk or b""), b
            if inner:
                out.append((row, doc_id, 2 * len(inner), None, None, code.encode(data[done:].decode()).astype("<u4").tobytes(), None, None, None, None))
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [coder(path).encode(t.decode()).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], names=["key", "part"])


def _assembled(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Texts' parts, sorted by text and place, put together."""
    row, doc_id, parts = None, None, []
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def whole() -> pa.RecordBatch:
        done = (doc_id, *_finished(coder(path), np.frombuffer(b"".join(parts), "<u4"), with_ids))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done, types)], names=names)

    for r in rows_of(batches):
        if r["row"] != row and row is not None:
            yield whole()
        if r["row"] != row:
            row, doc_id, parts = r["row"], r["doc_id"], []
        parts.append(r["part"])
    if row is not None:
        yield whole()


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of texts (``ids`` little-endian, 4 bytes each).

    ``tokenizer`` is a tokenizers file that every executor has. A first pass counts chunks by key; a
    filter of fixed size (4 MB) tells which may be shared. A second pass encodes what is not shared and
    sends each shared chunk's inner part to where it is encoded once; the parts are joined by key and
    put together by text. Where the filter errs or fills up, a chunk is sent though nothing shares it:
    results stay the same. ``decoded_sha256`` is of the text decoded from the ids.

    A null text counts as empty (no ids). Rows may repeat, ids may be null; each row gives one row.
    Other columns are not read. ``with_ids=False`` leaves ``ids`` null.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    keys = rows.select("text").mapInArrow(lean(_keys), "key binary").groupBy("key").count().where("count > 1")
    with step_conf(spark, texts=True):
        filters = keys.select("key").coalesce(4).mapInArrow(lean(_bits), "bits binary").collect()
    shared = np.zeros(FILTER_BITS // 8, np.uint8)
    for f in filters:
        shared |= np.frombuffer(f.bits, np.uint8)
    sent = spark.sparkContext.broadcast(shared)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    pieces = kept(numbered.mapInArrow(lean(lambda it: _pieces(it, tokenizer, sent.value, with_ids)), _PIECES), "pieces", texts=True)
    once = pieces.where("text is not null").select("key", "text").dropDuplicates(["key"])
    ids = kept(once.mapInArrow(lean(lambda it: _encoded(it, tokenizer)), "key binary, part binary"), "chunks", texts=True)
    used = pieces.where("key is not null").select("row", "doc_id", "seq", "key").join(ids, "key")
    parts = pieces.where("part is not null").select("row", "doc_id", "seq", "part").unionByName(used.select("row", "doc_id", "seq", "part"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_parts = parts.repartition(n, "row").sortWithinPartitions("row", "seq")
    joined = sorted_parts.mapInArrow(lean(lambda it: _assembled(it, tokenizer, with_ids)), f"doc_id long, {_DONE}")
    return pieces.where("n_tokens is not null").select(*joined.columns).unionByName(joined)
