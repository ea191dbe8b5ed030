"""Arrow forms of the functions from bytes to arrays, for jobs that decode most of what they read.

They work on whole batches: the offsets and bytes of a column as they are, one matrix of fixed width, and lists made
from such matrices, without a loop over rows or values. They give what the expressions in `arrays` and `octets`
give, null for null included.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.octets import FEATURE_BYTES, head

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """All bytes, where each row starts in them (one more at the end), and which rows are null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), None
    nulls = np.asarray(column.is_null()) if column.null_count else None
    column = column.cast(pa.large_binary()).fill_null(b"")  # offsets of 64 bits, whatever the session's types
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(starts) and starts[-1] else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0], nulls


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Rows of ``width`` bytes, filled up with zeros, which of them are content, and which rows are null.

    No row may be longer than ``width``.
    """
    data, starts, nulls = _octets(column)
    content = np.arange(width) < np.diff(starts)[:, None]
    out = np.zeros(content.shape, np.uint8)
    out[content] = data
    return out, content, nulls


def _lists(values: np.ndarray, starts: np.ndarray, nulls: np.ndarray | None) -> pa.Array:
    mask = None if nulls is None else pa.array(nulls)
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.reshape(-1)), mask=mask)


def _rows(matrix: np.ndarray, nulls: np.ndarray | None) -> pa.Array:
    return _lists(matrix, np.arange(len(matrix) + 1) * matrix.shape[1], nulls)


def byte_values_arrow(b: Column) -> Column:
    """Bytes as an array of integers 0..255."""

    @F.arrow_udf("array<int>")
    def convert(column: pa.Array) -> pa.Array:
        data, starts, nulls = _octets(column)
        return _lists(data.astype(np.int32), starts, nulls)

    return convert(b)


def unit_floats_arrow(b: Column, width: int = FEATURE_BYTES) -> Column:
    """Bytes divided by 255, cut or zero-filled to ``width`` values."""

    @F.arrow_udf("array<double>")
    def convert(column: pa.Array) -> pa.Array:
        octets, _, nulls = _matrix(column, width)
        return _rows(octets / 255.0, nulls)

    return convert(head(b, width))


def normalised_arrow(b: Column, width: int, mean: float, std: float, pad: str = "before") -> Column:
    """Unit floats, normalised and filled up to ``width``: ``"before"`` normalises the fill too, ``"after"`` leaves it 0."""
    if pad not in ("before", "after"):
        raise ValueError(f"pad must be 'before' or 'after', not {pad!r}")

    @F.arrow_udf("array<double>")
    def convert(column: pa.Array) -> pa.Array:
        octets, content, nulls = _matrix(column, width)
        scaled = (octets / 255.0 - mean) / std
        return _rows(scaled if pad == "before" else np.where(content, scaled, 0.0), nulls)

    return convert(head(b, width))


def patch_values_arrow(b: Column, patch: int, count: int) -> Column:
    """``count`` patches of ``patch`` byte values each, cut or filled up with zeros."""

    @F.arrow_udf("array<array<int>>")
    def convert(column: pa.Array) -> pa.Array:
        octets, _, nulls = _matrix(column, patch * count)
        patches = _rows(octets.reshape(-1, patch).astype(np.int32), None)
        starts = pa.array((np.arange(len(octets) + 1) * count).astype(np.int32))
        return pa.ListArray.from_arrays(starts, patches, mask=None if nulls is None else pa.array(nulls))

    return convert(head(b, patch * count))


def moments_arrow(values: Column) -> Column:
    """``n, m, var`` of an array of doubles: its size, mean and sample variance, null where there is none."""

    @F.arrow_udf("struct<n double, m double, var double>")
    def convert(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        nulls = np.asarray(column.is_null())
        lists = column.cast(pa.large_list(pa.float64())).fill_null([])
        flat, starts = np.asarray(lists.flatten(), float), np.asarray(lists.offsets)
        starts, n = starts - starts[0], np.diff(np.asarray(lists.offsets)).astype(float)
        some = np.flatnonzero(n)
        m, var = np.full(len(n), np.nan), np.full(len(n), np.nan)
        if len(some):
            m[some] = np.add.reduceat(flat, starts[some]) / n[some]
            squares = np.add.reduceat((flat - np.repeat(m, n.astype(int))) ** 2, starts[some])
            var[some] = squares / np.where(n[some] > 1, n[some] - 1, np.nan)
        fields = [pa.array(x, mask=nulls | np.isnan(x)) for x in (n, m, var)]
        return pa.StructArray.from_arrays(fields, ["n", "m", "var"])

    return convert(values)
