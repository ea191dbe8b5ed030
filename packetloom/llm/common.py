"""Helpers shared by the operators: stored tables, Arrow columns as bytes, packed arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.stored import new_path, stored

# Shuffle files of a job go when it is over, not at some later collection. Batches of texts for Python stay
# small: workers live on and keep what their largest batch took.
STEP_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2500",
}
# Steps over texts: batches by their bytes too, for Python and out of Parquet, since a batch is held several times over (the
# column's vector, its Arrow copy, Python's objects, the result), all of it beside the heap or as single large objects in it.
TEXT_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "1m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


@contextmanager
def step_conf(spark: SparkSession, texts: bool = False) -> Iterator[None]:
    """Settings of ``STEP_CONF``, with ``texts`` those of ``TEXT_CONF`` too, for the jobs in this block."""
    conf = STEP_CONF | (TEXT_CONF if texts else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back; its shuffle files go at once. ``texts``: in small batches."""
    with step_conf(df.sparkSession, texts):
        return stored(df, name)


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over batches, giving freed memory back to the system when its task ends.

    Python workers live on from task to task and from stage to stage, and with them what their allocators keep.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(column: str | Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.encode(text_of(column), "utf-8")))


def parts_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Partitions so that each holds about ``each`` bytes, at least the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each row starts in them (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), starts


def blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes in all, or one longer row."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += int(size)
    if len(sizes) > begin:
        yield begin, len(sizes)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, the width first."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield dict(zip(batch.schema.names, row))
