"""Web archives: written as whole-file gzip streams, normalised to a member per record, read by offset."""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import kept, rows_of, text_of
from packetloom.operators.stored import new_path

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
CHUNK = 1 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(location: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path in it; local paths may hold spaces and percent signs."""
    if location.startswith("file:"):
        return pa.fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlsplit(location).path)
    if "://" not in location:
        return pa.fs.LocalFileSystem(), location
    return pa.fs.FileSystem.from_uri(location)


def _moved(fs: pa.fs.FileSystem, path: str, to: str) -> None:
    """A finished file takes its place at once: attempts of a task don't mix."""
    fs.move(path, to)


class _Out:
    """A file written under another name until it is whole."""

    def __init__(self, location: str):
        self.fs, self.path = _store(location)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream, self.size = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        _moved(self.fs, self.own, self.path)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _safe(value: object) -> str:
    return "".join(c if c > " " else urllib.parse.quote(c) for c in str(value))


def _record(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header alone."""
    payload = (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["kind"] == "revisit"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row['kind']}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(row['url'] or '')}", f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _written(batches: Iterator[pa.RecordBatch], directory: str) -> Iterator[pa.RecordBatch]:
    """Records as whole-file gzip archives of bounded size; one row for each archive."""
    task, number, out = TaskContext.get().partitionId(), 0, None
    for row in rows_of(batches):
        if out is None:
            path = f"{directory}/part-{task:06d}-{number:04d}.warc.gz"
            out, squeeze, size = _Out(path), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        data = _record(row)
        size += len(data)
        out.write(squeeze.compress(data))
        if size >= ARCHIVE_BYTES:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path]})
            out, number = None, number + 1
    if out is not None:
        out.write(squeeze.flush())
        out.close()
        yield pa.RecordBatch.from_pydict({"archive": [path]})


class Inflated:
    """A gzip file inflated once from front to end, with a bounded buffer; members may follow one another."""

    def __init__(self, stream):
        self.stream, self.inflate, self.data, self.rest = stream, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            raw = self.inflate.unconsumed_tail or self.rest or self.stream.read(CHUNK)
            self.rest = b""
            if not raw:
                if self.inflate.eof or self.fresh():
                    return False
                raise EOFError("the gzip stream ends early")
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(raw, CHUNK)
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
            self.begun = True
            if got:
                self.data += got
                return True

    begun = False

    def fresh(self) -> bool:
        return not self.begun

    def head(self) -> bytes | None:
        """Bytes up to and with the next empty line; None at the end."""
        seen = 0
        while (at := self.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.data)
            if not self._more():
                if self.data.strip():
                    raise EOFError("a record's header ends early")
                return None
        out, self.data = self.data[: at + 4], self.data[at + 4 :]
        return out

    def some(self, n: int) -> bytes:
        """Up to ``n`` bytes, at least one."""
        while not self.data:
            if not self._more():
                raise EOFError("a record ends early")
        out, self.data = self.data[:n], self.data[n:]
        return out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if v}


def _normalised(batches: Iterator[pa.RecordBatch], directory: str) -> Iterator[pa.RecordBatch]:
    """Each archive inflated once and rewritten with a gzip member per record, beside an offset index."""
    for row in rows_of(batches):
        fs, path = _store(row["archive"])
        name = path.rsplit("/", 1)[1]
        out, index = _Out(f"{directory}/{name}"), _Out(f"{directory}/{name}.idx")
        with fs.open_input_stream(path, compression=None) as stream:
            whole = Inflated(stream)
            while (head := whole.head()) is not None:
                about, offset = fields(head), out.size
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(squeeze.compress(head))
                left = int(about["content-length"]) + 4
                while left:
                    part = whole.some(min(left, CHUNK))
                    left -= len(part)
                    out.write(squeeze.compress(part))
                out.write(squeeze.flush())
                entry = {"archive": f"{directory}/{name}", "offset": offset, "length": out.size - offset, "type": about.get("warc-type"), "id": about.get("warc-record-id")}
                index.write((json.dumps(entry) + "\n").encode())
        out.close()
        index.close()
        yield pa.RecordBatch.from_pydict({"index": [f"{directory}/{name}.idx"]})


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records at the offsets of the index, their digests checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    opened, stream, out, size = None, None, [], 0
    for row in rows_of(batches):
        if row["archive"] != opened:
            fs, path = _store(row["archive"])
            opened, stream = row["archive"], fs.open_input_file(path)
        data = zlib.decompress(stream.read_at(row["length"], row["offset"]), 31)
        head, _, block = data.partition(b"\r\n\r\n")
        about = fields(head)
        http, _, payload = block[: int(about["content-length"])].partition(b"\r\n\r\n")
        digest = about["warc-payload-digest"].removeprefix("sha1:")
        revisit = about["warc-type"] == "revisit"
        n_bytes = int(fields(http)["content-length"])
        if not revisit and (len(payload) != n_bytes or base32(hashlib.sha1(payload).hexdigest()) != digest):
            raise ValueError(f"record {about['warc-record-id']} of {opened} isn't what its header says")
        out.append((_page(about["warc-record-id"]), about.get("warc-target-uri", ""), n_bytes, digest, about["warc-type"], _page(about.get("warc-refers-to")), None if revisit else payload))
        size += len(payload)
        if size > CHUNK * 4:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """``page_id, url, html, payload_bytes, sha1, kind, refers_to`` of pages.

    Of pages with one payload of ``least`` bytes or more that with the smallest id is a response
    and the others revisit it; a repeated row of that id is a response too. Null ids come last.
    """
    data: Column = F.encode(text_of(html), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.octet_length(data).cast("long").alias("payload_bytes"), F.sha1(data).alias("sha1"))
    shared = rows.groupBy(F.col("sha1").alias("__sha1")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(kept(shared, "payloads"), F.col("sha1") == F.col("__sha1"), "left")
    again = F.col("first").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "sha1",
        F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, directory: str) -> DataFrame:
    """Write rows of ``with_revisits`` as archives that are one gzip stream each; ``archive`` paths."""
    return kept(records.mapInArrow(lambda it: _written(it, directory), "archive string"), "archives")


def normalise(archives: DataFrame, directory: str) -> DataFrame:
    """Rewrite archives (column ``archive``) with a gzip member per record; paths of the ``index`` sidecars.

    Each archive is inflated once, as a stream with a bounded buffer, in a task of its own. Archives
    that already have members are taken too; a cut-off archive fails the job.
    """
    n = max(1, archives.count())
    spread = archives.repartition(n).select("archive")
    return kept(spread.mapInArrow(lambda it: _normalised(it, directory), "index string"), "indexes")


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Records of the archives below ``directory``, found through their sidecar indexes.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for revisits).
    """
    index = spark.read.schema("archive string, offset long, length long").json(f"{directory}/*.idx")
    at = F.floor(F.col("offset") / RANGE_BYTES)
    parts = max(1, -(-int(index.agg(F.sum("length")).first()[0] or 0) // RANGE_BYTES))
    return index.repartition(parts, "archive", at).sortWithinPartitions("archive", "offset").mapInArrow(_read, _READ)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write pages as whole-file gzip archives, normalise these, and read the records back.

    A null or empty ``html`` is an empty payload, a null ``url`` an empty one; ids may be null or
    repeat, each row gives a record; an empty table gives no archive and no row. Other columns of
    ``pages`` are not written. Archives lie below ``spark.checkpoint.dir``.
    """
    spark = pages.sparkSession
    raw, clean = new_path(spark, "warc"), new_path(spark, "warc-members")
    archives = write_archives(with_revisits(pages, page_id, url, html, least), raw)
    if normalise(archives, clean).isEmpty():
        return spark.createDataFrame([], _READ)
    return read_archives(spark, clean)
