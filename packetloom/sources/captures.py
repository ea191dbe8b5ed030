"""Capture files as packet tables.

Small files come through Spark's ``binaryFile`` source, one value per file, many to a task and a batch. A file too
large for one value is read by byte ranges. A capture has no sync marks: each range guesses where its first record
begins, from a chain of plausible headers, and walks to its end. The guess is proven if the range before, itself
proven, ends there; the first range of a file begins after the file header. Ranges that guessed wrong are walked again
from where the one before ended. Packets are then parsed range by range, all over the cluster.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.names import directory_label
from packetloom.operators.stored import stored

# Tasks carry this module's functions with them, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Header sizes and the magic numbers with byte order and time unit.
FILE_HEADER = 24
RECORD_HEADER = 16
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
BATCH_PACKETS = 5000
# A header looks like one if its lengths are at most so large and its time is this close to the file's first;
# so many in a row make a guess.
LONGEST = 1 << 18
CLOSE_SECONDS = 1 << 28
CHAIN = 16
# Rounds in which ranges that guessed wrong are walked again.
ROUNDS = 4
RANGE_TYPES = (
    "path string, k long, begin long, end long, start long, stop long, n long, byte_order string, per_second long, link int"
)
RANGE_COLUMNS = ["path", "k", "begin", "end", "start", "stop", "n", "byte_order", "per_second", "link"]
BATCHES_PER_FILE = 5

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("frame_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("cap_len", T.LongType()),
        T.StructField("wire_len", T.LongType()),
        T.StructField("link_type", T.IntegerType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("packet", T.BinaryType()),
    ]
)

_ARROW = pa.schema(
    [
        ("label", pa.string()),
        ("file_path", pa.string()),
        ("frame_no", pa.int64()),
        ("ts", pa.timestamp("us", tz="UTC")),
        ("cap_len", pa.int64()),
        ("wire_len", pa.int64()),
        ("link_type", pa.int32()),
        ("truncated", pa.bool_()),
        ("packet", pa.binary()),
    ]
)


def _file_header(head: bytes, path: str) -> tuple[str, int, int]:
    if head[:4] not in MAGIC or len(head) < FILE_HEADER:
        raise ValueError(f"not a capture file: {path}")
    order, per_second = MAGIC[head[:4]]
    return order, per_second, struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF


def _starts(data: bytes, start: int, order: str, limit: int) -> tuple[np.ndarray, int]:
    """Where up to ``limit`` whole record headers begin, and where the next record begins."""
    length = struct.Struct(order + "8xI4x")
    found, end = [], len(data) - RECORD_HEADER
    while start <= end and len(found) < limit:
        found.append(start)
        start += RECORD_HEADER + length.unpack_from(data, start)[0]
    return np.array(found, np.int64), start


def _packets(data: bytes, start: int, order: str, per_second: int, size: int) -> Iterator[tuple]:
    """``(microseconds, captured, on the wire, packets)`` as arrays, ``size`` records at a time.

    Only lengths are walked one by one; the other header fields are read for all records at once. A
    cut-off record has fewer bytes than captured.
    """
    raw = np.frombuffer(data, np.uint8)
    while True:
        at, start = _starts(data, start, order, size)
        if not len(at):
            return
        heads = raw[at[:, None] + np.arange(RECORD_HEADER)].copy().view(f"{order}u4").astype(np.int64)
        micros = heads[:, 0] * 1_000_000 + heads[:, 1] * 1_000_000 // per_second
        begin = at + RECORD_HEADER
        stop = np.minimum(begin + heads[:, 2], len(data))
        yield micros, heads[:, 2], heads[:, 3], [data[b:e] for b, e in zip(begin.tolist(), stop.tolist())]


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    """Rows of ``(label, path, first frame, link, packets)`` of one or more files."""
    sizes = [len(p[4][3]) for p in parts]
    part = pa.array(np.repeat(np.arange(len(parts)), sizes))
    micros, captured, wire = (np.concatenate([p[4][i] for p in parts]) for i in range(3))
    packets = [x for p in parts for x in p[4][3]]
    held = np.fromiter(map(len, packets), np.int64, len(packets))
    columns = [
        pa.array([p[0] for p in parts], pa.string()).take(part),
        pa.array([p[1] for p in parts], pa.string()).take(part),
        pa.array(np.concatenate([np.arange(p[2], p[2] + n) for p, n in zip(parts, sizes)])),
        pa.array(micros).cast(pa.timestamp("us", tz="UTC")), pa.array(captured), pa.array(wire),
        pa.array([p[3] for p in parts], pa.int32()).take(part), pa.array(held < captured), pa.array(packets, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _gathered(parts: Iterator[tuple], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` packets or more, over the borders of files."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[4][3])
        if rows >= size:
            yield _batch(held)
            held, rows = [], 0
    if held:
        yield _batch(held)


def parse_captures(files: DataFrame, label: str | None = None, batch: int = BATCH_PACKETS) -> DataFrame:
    """Packets of ``(path, content)`` rows, in the columns of ``PACKET_SCHEMA``.

    The label is the directory name, or the given column. A last record cut short is kept with
    ``truncated`` set.
    """
    named = directory_label(F.col("path")) if label is None else F.col(label)
    files = files.select(named.cast("string").alias("label"), "path", "content")

    def parsed(values: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in values:
            for name, path, content in zip(*(part.column(i) for i in range(3))):
                data, path, first = content.as_py(), path.as_py(), 1
                order, per_second, link = _file_header(data[:FILE_HEADER], path)
                for found in _packets(data, FILE_HEADER, order, per_second, batch):
                    yield name.as_py(), path, first, link, found
                    first += len(found[3])

    return files.mapInArrow(lambda values: _gathered(parsed(values), batch), PACKET_SCHEMA)


def capture_files(
    spark: SparkSession, root: str, pattern: str = "*.pcap", content: bool = True, stream: bool = False, **options: str
) -> DataFrame:
    """Capture files below ``root``; without ``content`` only path and length are read."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").schema(BINARY_FILE_SCHEMA)
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    for key, value in options.items():
        reader = reader.option(key, value)
    files = reader.load(root)
    return files if content else files.select("path", "length")


def _file_system(path: str) -> tuple:
    """The Arrow file system of a path as Spark shows it, in which nothing is escaped, and the name there."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))


def _open(path: str):
    system, name = _file_system(path)
    return system.open_input_file(name)


def write_files(files: DataFrame, root: str) -> int:
    """Write ``content`` of each row to ``path`` below ``root``, in tasks; a task that runs again writes the same.

    Returns how many rows were written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _file_system(f"{root.rstrip('/')}/{path.lstrip('/')}")
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return files.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _ranges(path: str, target: int) -> Iterator[tuple]:
    """``(path, order, per_second, link, first frame, offset, length)`` pieces of about ``target`` bytes."""
    with _open(path) as f:
        size = f.size()
        order, per_second, link = _file_header(f.read_at(FILE_HEADER, 0), path)
        header = struct.Struct(order + "IIII")
        at = begin = FILE_HEADER
        frame = first = 1
        window, window_at = b"", 0
        while at + RECORD_HEADER <= size:
            if not (window_at <= at and at + RECORD_HEADER <= window_at + len(window)):
                window_at, window = at, f.read_at(min(1 << 20, size - at), at)
            at += RECORD_HEADER + header.unpack_from(window, at - window_at)[2]
            frame += 1
            if at - begin >= target:
                yield path, order, per_second, link, first, begin, min(at, size) - begin
                begin, first = at, frame
        if begin < size and frame > first:
            yield path, order, per_second, link, first, begin, min(at, size) - begin


def _guess(f, size: int, order: str, per_second: int, first_second: int, begin: int, end: int) -> int:
    """Where the first record at or after ``begin`` seems to start; -1 if nothing before ``end`` looks like one."""
    window = 1 << 20
    for at in range(begin, end, window):
        data = np.frombuffer(f.read_at(min(window + (1 << 18), size - at), at), np.uint8).astype(np.uint32)
        if len(data) < RECORD_HEADER:
            return -1
        places = (0, 1, 2, 3) if order == "<" else (3, 2, 1, 0)
        word = sum(data[i : len(data) - 3 + i] << np.uint32(8 * p) for i, p in enumerate(places)).astype(np.int64)
        n = len(word) - 12
        second, part, captured, wire = (word[i : i + n] for i in (0, 4, 8, 12))
        fits = (part < per_second) & (captured <= LONGEST) & (captured <= wire) & (wire <= 256 * LONGEST)
        fits &= np.abs(second - first_second) < CLOSE_SECONDS
        for start in np.flatnonzero(fits[: min(window, end - at)]).tolist():
            next_, links = start, 0
            while next_ < n and links < CHAIN and fits[next_]:
                next_, links = next_ + RECORD_HEADER + int(captured[next_]), links + 1
            if links == CHAIN or next_ >= n:
                return at + start
    return -1


def _walk(f, size: int, order: str, start: int, end: int) -> tuple[int, int]:
    """Where the first record at or after ``end`` starts, going from the one at ``start``, and how many lie before it."""
    header = struct.Struct(order + "8xI4x")
    at, n, window, window_at = start, 0, b"", 0
    while at < end and at + RECORD_HEADER <= size:
        if not (window_at <= at and at + RECORD_HEADER <= window_at + len(window)):
            window_at, window = at, f.read_at(min(1 << 20, size - at), at)
        at += RECORD_HEADER + header.unpack_from(window, at - window_at)[0]
        n += 1
    return at, n


def _walked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges ``(path, k, begin, end, start)`` with ``start`` guessed where it is null, where each stops, and its records."""
    for part in parts:
        rows = []
        for path, k, begin, end, start in part.itertuples(index=False):
            with _open(path) as f:
                size, head = f.size(), f.read_at(FILE_HEADER + RECORD_HEADER, 0)
                order, per_second, link = _file_header(head[:FILE_HEADER], path)
                if k == 0:
                    start = FILE_HEADER
                elif pd.isna(start):
                    second = struct.unpack_from(order + "I", head, FILE_HEADER)[0]
                    start = _guess(f, size, order, per_second, second, begin, end)
                stop, n = _walk(f, size, order, int(start), end) if start >= 0 else (-1, 0)
            rows.append((path, k, begin, end, int(start), stop, n, order, per_second, link))
        yield pd.DataFrame(rows, columns=RANGE_COLUMNS)


def _proven_ranges(files: DataFrame, target: int) -> DataFrame:
    """``path, byte_order, per_second, link, first, at, size`` of ranges of about ``target`` bytes."""
    records = F.col("length") - FILE_HEADER
    last = F.greatest(F.ceil(records / target) - 1, F.lit(0)).cast("long")
    begin = F.lit(FILE_HEADER) + F.col("k") * target
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    ranges = ranges.select("path", "k", begin.alias("begin"), F.least(begin + target, "length").alias("end"), F.lit(None).cast("long").alias("start"))
    ranges = stored(ranges, "capture-ranges")
    ranges = stored(_dealt(ranges).mapInPandas(_walked, RANGE_TYPES), "capture-ranges")
    file = Window.partitionBy("path").orderBy("k")
    for _ in range(ROUNDS):
        wrong = ranges.withColumn("before", F.lag("stop").over(file)).where("before <> start")
        wrong = stored(wrong.select("path", "k", "begin", "end", F.col("before").alias("start")), "wrong-ranges")
        if wrong.isEmpty():
            break
        again = _dealt(wrong).mapInPandas(_walked, RANGE_TYPES)
        ranges = stored(ranges.join(wrong, ["path", "k"], "left_anti").unionByName(again), "capture-ranges")
    before = F.sum("n").over(file) - F.col("n")
    ranges = ranges.withColumn("first", before + 1).withColumn("wrong", F.lag("stop").over(file) != F.col("start"))
    # Files in which ranges still don't meet are walked in one go.
    odd = stored(ranges.where("wrong").select("path").distinct(), "odd-files")
    size = F.least("stop", F.max("end").over(Window.partitionBy("path"))) - F.col("start")
    proven = ranges.withColumn("size", size).join(odd, "path", "left_anti").where("n > 0")
    proven = proven.select("path", "byte_order", "per_second", "link", "first", F.col("start").alias("at"), "size")
    return proven if odd.isEmpty() else proven.unionByName(_whole_walk(odd, target, odd.count()))


def _dealt(ranges: DataFrame) -> DataFrame:
    """A range to a task: adaptive execution would merge the tiny rows."""
    return ranges.repartition(max(1, ranges.count()), "path", "k")


def _whole_walk(files: DataFrame, target: int, tasks: int) -> DataFrame:
    """The same ranges, each file walked in one task."""
    names = ["path", "byte_order", "per_second", "link", "first", "at", "size"]
    types = "path string, byte_order string, per_second long, link int, first long, at long, size long"

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                yield pd.DataFrame(list(_ranges(path, target)), columns=names)

    return files.select("path").repartition(tasks, "path").mapInPandas(walk, types)


def scan_ranges(files: DataFrame, target: int = 64 << 20, batch: int = BATCH_PACKETS, tasks: int | None = None) -> DataFrame:
    """Packets of files of any size, given ``path, length``; any file system Arrow can open.

    Ranges of about ``target`` bytes are dealt to ``tasks`` tasks, a number that adaptive execution leaves as it is. By
    default it is the number of ranges. In a stream each new file is walked in one task, as its
    ranges can't be compared with each other there, and the session's partitions share the ranges.
    """
    usual = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if files.isStreaming:
        ranges = _whole_walk(files, target, usual)
    else:
        ranges = stored(_proven_ranges(files, target), "capture-ranges")
        tasks = tasks or max(1, ranges.count())
    ranges = ranges.repartition(tasks or usual, "path", "at").withColumn("label", directory_label(F.col("path")))
    ranges = ranges.select("label", "path", "byte_order", "per_second", "link", "first", "at", "size")

    def parsed(values: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in values:
            for label, path, order, per_second, link, first, at, size in zip(*(c.to_pylist() for c in part.columns)):
                with _open(path) as f:
                    data = f.read_at(size, at)
                for found in _packets(data, 0, order, per_second, batch):
                    yield label, path, first, link, found
                    first += len(found[3])

    return ranges.mapInArrow(lambda values: _gathered(parsed(values), batch), PACKET_SCHEMA)


def read_captures(
    spark: SparkSession,
    root: str,
    pattern: str = "*.pcap",
    large: int = 128 << 20,
    batch: int = BATCH_PACKETS,
    max_batches: int | None = None,
    stream: bool = False,
    target: int = 64 << 20,
    **options: str,
) -> DataFrame:
    """Packets of all capture files below ``root``, as a stream of new files with ``stream``.

    Files up to ``large`` bytes are read by Spark, longer ones, which a value may not hold, by ranges of about
    ``target`` bytes; both give the same rows. ``max_batches`` keeps the first ``batch * max_batches`` packets of every file.
    """
    small = capture_files(spark, root, pattern, stream=stream, **options).where(F.col("length") <= large)
    big = capture_files(spark, root, pattern, content=False, stream=stream, **options).where(F.col("length") > large)
    packets = parse_captures(small, batch=batch)
    if stream or not big.isEmpty():
        packets = packets.unionByName(scan_ranges(big, target, batch))
    return packets.where(F.col("frame_no") <= batch * max_batches) if max_batches else packets
