"""Exact removal of repeated byte strings, by names of difference-cover samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import blocks, buffers, kept, parts_for, text_key, text_of

# Period and perfect difference set; every residue is a difference of two members.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
BLOCK_BYTES = 1 << 20
SAMPLE_BUCKET = 16 << 20  # bytes of text whose sampled names meet in one bucket
SUFFIX_BUCKET = 8 << 20
SEGMENT = 1 << 20
FILTER_BITS = 1 << 25
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
SYMBOLS = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(SEGMENT + 4096, np.uint64(base))]))


_POWERS: list[np.ndarray] = []


def names(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit name of the ``length`` bytes from each place on where there are so many."""
    if not _POWERS:
        _POWERS.extend((_powers(int(BASE)), _powers(pow(int(BASE), -1, 1 << 64))))
    forward, back = _POWERS
    out = [np.zeros(0, np.uint64)]
    for begin in range(0, len(data) - length + 1, SEGMENT):
        part = data[begin : begin + SEGMENT + length - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(SYMBOLS[part] * forward[: len(part)])])
        code = (sums[length:] - sums[:-length]) * back[: len(part) - length + 1]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            code = (code ^ (code >> np.uint64(shift))) * np.uint64(factor)
        out.append(code ^ (code >> np.uint64(31)))
    return np.concatenate(out)


class Cover:
    """Sampling for strings of ``width`` bytes: two equal strings have a sample at the same place in both.

    A sampled tuple of ``tuple_bytes`` bytes from there on lies within the string.
    """

    def __init__(self, width: int):
        self.period = max((v for v in COVERS if v <= max(3, width * 3 // 5)), default=3)
        self.residues = np.array(COVERS[self.period])
        self.width, self.tuple_bytes = width, width - self.period + 1

    def places(self, n: int) -> np.ndarray:
        """Sampled places of a text of ``n`` bytes whose tuple fits in."""
        steps = np.arange(0, max(0, n), self.period)
        at = (steps[:, None] + self.residues).ravel()
        return at[at + self.tuple_bytes <= n]


class Block:
    """Texts of one stored row: ids, the order in the corpus, bytes."""

    def __init__(self, starts: bytes, data: bytes):
        self.starts = np.frombuffer(starts, np.int64)
        self.data = np.frombuffer(data, np.uint8)

    def texts(self) -> Iterator[tuple[int, np.ndarray]]:
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            yield a, self.data[a:b]

    def samples(self, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places in the block, and the names of their tuples."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for begin, text in self.texts():
            at = cover.places(len(text))
            if len(at):
                places.append(at + begin)
                found.append(names(text, cover.tuple_bytes)[at])
        return np.concatenate(places), np.concatenate(found)

    def suffixes(self, cover: Cover, replies: list[tuple[int, bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose ``width`` bytes hold a sample with a repeated name, and names of those bytes."""
        at, found = self.samples(cover)
        unique, place = np.unique(found, return_inverse=True)
        hit = np.zeros(len(self.data) + 1, np.int64)
        marked = at[Deal(unique, sample_bucket(unique, n), n).told(replies)[place]]
        np.add.at(hit, np.maximum(marked - cover.period + 1, 0), 1)
        np.add.at(hit, marked + 1, -1)
        near = np.cumsum(hit[:-1]) > 0
        places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for begin, text in self.texts():
            fits = len(text) - cover.width + 1
            if fits > 0 and (pick := np.flatnonzero(near[begin : begin + fits])).size:
                places.append(pick + begin)
                codes.append(names(text, cover.width)[pick])
        return np.concatenate(places), np.concatenate(codes)


class Deal:
    """Distinct sorted names of a block, dealt out to buckets; a bucket answers with a bit for each."""

    def __init__(self, values: np.ndarray, bucket: np.ndarray, n: int):
        self.values, self.order = values, np.argsort(bucket, kind="stable")
        self.at = np.searchsorted(bucket[self.order], np.arange(n + 1))

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for b in np.flatnonzero(np.diff(self.at)).tolist():
            yield b, self.order[self.at[b] : self.at[b + 1]]

    def told(self, replies: list[tuple[int, bytes]]) -> np.ndarray:
        flags = np.zeros(len(self.values), bool)
        for b, bits in replies:
            mine = self.order[self.at[b] : self.at[b + 1]]
            flags[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).view(bool)
        return flags


def sample_bucket(names_: np.ndarray, n: int) -> np.ndarray:
    return (names_ & np.uint64(0xFFFFFF)).astype(np.int64) % n


def suffix_bucket(names_: np.ndarray, n: int) -> np.ndarray:
    return (names_ >> np.uint64(8)).astype(np.int64) % n


def short(found: np.ndarray) -> np.ndarray:
    """Names of samples cut to 40 bits: they only find candidates."""
    return found >> np.uint64(24)


def _as_bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _as_numbers(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


_DEALT = "bucket int, block long, codes binary, again binary"
_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
_NAMES = ["bucket", "block", "codes", "again"]
_REPLY = "block long, bucket int, bits binary"


def _table(rows: list[tuple], types: tuple, names_: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names_)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order as rows of about a megabyte, numbered in order."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, at = buffers(batch.column("text"))
        for begin, end in blocks(np.diff(at), BLOCK_BYTES):
            ids = batch.column("doc_id").slice(begin, end - begin)
            row = {"block": [(task << 32) + number], "ids": [ids.to_pylist()], "starts": [(at[begin : end + 1] - at[begin]).astype(np.int64).tobytes()], "data": [data[at[begin] : at[end]].tobytes()]}
            number += 1
            yield pa.RecordBatch.from_pydict(row, pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.binary()), ("data", pa.binary())]))


def _sampled(batches: Iterator[pa.RecordBatch], cover: Cover, n: int) -> Iterator[pa.RecordBatch]:
    """Names of a block's sampled tuples by bucket, and which of them repeat in the block."""
    for batch in batches:
        for block, starts, data in zip(*[batch.column(c) for c in ("block", "starts", "data")]):
            unique, times = np.unique(Block(starts.as_py(), data.as_py()).samples(cover)[1], return_counts=True)
            deal = Deal(unique, sample_bucket(unique, n), n)
            rows = [(b, block.as_py(), _as_bytes(short(unique[pick]), 5), np.packbits(times[pick] > 1).tobytes()) for b, pick in deal.parts()]
            if rows:
                yield _table(rows, _TYPES, _NAMES)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (bucket, block, codes, again) of each bucket, from rows sorted by bucket."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _replies(rows: list[tuple], wanted: np.ndarray, width: int) -> pa.RecordBatch:
    edges = np.cumsum([0] + [len(r[2]) // width for r in rows]).tolist()
    out = [(r[1], r[0], np.packbits(wanted[a:b]).tobytes()) for r, a, b in zip(rows, edges, edges[1:]) if wanted[a:b].any()]
    return _table(out, (pa.int64(), pa.int32(), pa.binary()), ["block", "bucket", "bits"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted names with an equal neighbour, told to the blocks that hold them."""
    for rows in _by_bucket(batches):
        code = _as_numbers(b"".join(r[2] for r in rows), 5)
        wanted = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(r[2]) // 5) for r in rows]).view(bool)
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        wanted[order[1:]] |= same
        wanted[order[:-1]] |= same
        yield _replies(rows, wanted, 5)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names equal to their neighbour in order of (name, block): they start in an earlier block too."""
    for rows in _by_bucket(batches):
        code = np.frombuffer(b"".join(r[2] for r in rows), "<u8")
        owner = np.repeat([r[1] for r in rows], [len(r[2]) // 8 for r in rows])
        order = np.lexsort((owner, code))
        wanted = np.zeros(len(code), bool)
        wanted[order[1:]] = code[order][1:] == code[order][:-1]
        yield _replies(rows, wanted, 8)


def _pairs(table: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))


def _merged(left: pa.Table, right: pa.Table, cover: Cover, n: int, m: int, turn: int, turns: int) -> pa.Table:
    """Names of a block's candidate suffixes, cut to ``width`` bytes, for the buckets of this turn."""
    rows = []
    for block, starts, data in zip(*[left.column(c) for c in ("block", "starts", "data")]):
        unique = np.unique(Block(starts.as_py(), data.as_py()).suffixes(cover, _pairs(right), n)[1])
        deal = Deal(unique, suffix_bucket(unique, m), m)
        rows += [(b, block.as_py(), _as_bytes(unique[pick], 8), None) for b, pick in deal.parts() if b % turns == turn]
    return pa.Table.from_batches([_table(rows, _TYPES, _NAMES)])


_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"
_OUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())


def _removed(left: pa.Table, first: pa.Table, cover: Cover, n: int, m: int) -> pa.Table:
    """Each text of a block without the bytes that repeated strings cover."""
    rows = []
    early = first.filter(pa.compute.equal(first.column("kind"), 0))
    late = first.filter(pa.compute.equal(first.column("kind"), 1))
    for ids, starts, data in zip(*[left.column(c) for c in ("ids", "starts", "data")]):
        block = Block(starts.as_py(), data.as_py())
        places, codes = block.suffixes(cover, _pairs(early), n)
        unique, first_at, place = np.unique(codes, return_index=True, return_inverse=True)
        again = Deal(unique, suffix_bucket(unique, m), m).told(_pairs(late))[place]
        again |= first_at[place] != np.arange(len(codes))
        edge = np.zeros(len(block.data) + 1, np.int64)
        np.add.at(edge, places[again], 1)
        np.add.at(edge, places[again] + cover.width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for doc_id, (begin, text) in zip(ids.as_py(), block.texts()):
            mine = gone[begin : begin + len(text)]
            change = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            spans = [{"begin": a, "end": b} for a, b in change.reshape(-1, 2).tolist()]
            rows.append((doc_id, len(text), int(mine.sum()), spans, text[~mine].tobytes()))
    return pa.Table.from_batches([_table(rows, _OUT_TYPES, [x.split()[0] for x in ("doc_id", "n_bytes", "n_removed", "spans", "kept")])])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[batch.column("bit").to_numpy()] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _once(docs: DataFrame, doc_id: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct texts under their first id, and the other copies with their number.

    A filter of fixed size says which texts may have copies; only those are shuffled by their key.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).cast("int")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), text_key(text).alias("key")).withColumn("bit", bit)
    ids = rows.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.octet_length("text") < width, F.col("text")).alias("text"))
    counted = kept(ids.groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes"), F.first("text").alias("short")), "ids")
    shared = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")).where("n > 1")
    shared = kept(shared.select("key", F.col("least.doc_id").alias("first")), "copied")
    filters = shared.select(bit.alias("bit")).coalesce(4).mapInArrow(_bits, "bits binary").collect()
    word = np.zeros(FILTER_BITS // 8, np.uint8)
    for f in filters:
        word |= np.frombuffer(f.bits, np.uint8)
    sent = spark.sparkContext.broadcast(word.tobytes())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            b = batch.column("bit").to_numpy()
            maybe = (bits[b >> 3] & (0x80 >> (b & 7)).astype(np.uint8)) > 0
            key = pa.array([k if m else None for k, m in zip(batch.column("key").to_pylist(), maybe)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), key], names=["doc_id", "text", "key"])

    tagged = rows.mapInArrow(split, "doc_id long, text string, key binary")
    single = tagged.where("key is null").select("doc_id", "text")
    merged = tagged.where("key is not null").groupBy("key").agg(F.first("text").alias("text"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    distinct = single.unionByName(merged.select(F.col("least.doc_id").alias("doc_id"), "text"))
    copies = counted.join(shared, "key").withColumn("times", F.col("n") - F.col("doc_id").eqNullSafe(F.col("first")).cast("long"))
    return distinct, copies.where("times > 0").select("doc_id", "n_bytes", "short", F.col("times").cast("int").alias("times"))


def remove_repeats(docs: DataFrame, width: int = 100, doc_id: str = "doc_id", text: str = "text", turns: int = 2) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: texts without bytes covered by an earlier string of ``width`` bytes.

    Earlier means in a text of a smaller id, or before in the same text; strings are judged on the
    input and may overlap. ``spans`` are the removed byte ranges, ``kept`` the bytes left.

    Copies of a whole text are set aside first. The other texts are put in order and cut into blocks.
    Places sampled by a difference cover get names for the tuple of bytes that begins there; names
    meet by bucket, are sorted, and equal neighbours tell their blocks. Cut at ``width`` bytes a
    suffix needs no deeper recursion: the tuple after its sample and the bytes before it make up all
    of it. Suffixes near a repeated sample are named, merged by bucket in order of (name, block), and
    those equal to their neighbour are repeats. A block sends each name once, so a passage in
    a third of all texts costs one name a block, and gets a bit for each back. The names of suffixes
    are shuffled in ``turns``, each a part of the buckets, to hold fewer on disk at once.

    Null texts count as empty. Rows with one id are ordered by their text's hash, null ids come last;
    repeated rows are copies of the first. Names have 64 bits. Other columns are not read.
    """
    spark, cover = docs.sparkSession, Cover(width)
    distinct, copies = _once(docs, doc_id, text, width)
    n_bytes = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    n, m = parts_for(spark, n_bytes, SAMPLE_BUCKET), parts_for(spark, n_bytes, SUFFIX_BUCKET)
    order = [F.col("doc_id").asc_nulls_last()]
    placed = distinct.repartitionByRange(n, *order).sortWithinPartitions(*order, F.xxhash64("text"))
    stored = kept(placed.mapInArrow(_blocked, "block long, ids array<long>, starts binary, data binary"), "blocks")
    texts = stored.select("block", "starts", "data")
    dealt = texts.mapInArrow(lambda it: _sampled(it, cover, n), _DEALT)
    early = kept(dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, _REPLY), "samples")
    replies = early.withColumn("kind", F.lit(0))

    def suffixes_of(turn: int) -> DataFrame:
        merged = lambda a, b: _merged(a, b, cover, n, m, turn, turns)
        return texts.groupBy("block").cogroup(early.groupBy("block")).applyInArrow(merged, _DEALT)

    for turn in range(turns):
        suffixes = suffixes_of(turn)
        late = kept(suffixes.repartition(m, "bucket").sortWithinPartitions("bucket").mapInArrow(_later, _REPLY), "repeats")
        replies = replies.unionByName(late.withColumn("kind", F.lit(1)))
    own = stored.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: _removed(a, b, cover, n, m), _OUT)
    again = copies.select("doc_id", "n_bytes", "short", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    whole = F.col("short").isNull()
    spans = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.array())
    again = again.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"), spans.alias("spans"), F.encode(text_of("short"), "utf-8").alias("kept"))
    return own.unionByName(again)
