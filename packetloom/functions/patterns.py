"""Many short patterns looked for in many texts at once.

For each pattern length every window of that length is coded at once (up to eight bytes as they are, longer ones by
a polynomial modulo 2^64) and looked up among the patterns' codes; windows found by the polynomial are compared byte by byte.
The work is one pass per length, however many patterns there are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text looked at together.
BLOCK = 2 << 20
EXACT = 8


def _multiplier(patterns: list[bytes]) -> int:
    """An odd multiplier under which patterns of one length have different codes."""
    multiplier = 0x9E3779B97F4A7C15
    while True:
        codes = {(len(p), _polynomial(np.frombuffer(p, np.uint8), len(p), multiplier)[0]) for p in patterns if len(p) > EXACT}
        if len(codes) == sum(len(p) > EXACT for p in patterns):
            return multiplier
        multiplier = (multiplier * 6364136223846793005 + 2) % (1 << 64)


def _polynomial(data: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """Code of each window: the sum of its bytes times powers of the multiplier, the last byte by the first power."""
    out = np.zeros(len(data) - length + 1, np.uint64)
    m = np.uint64(multiplier)
    for i in range(length):
        out = (out + data[i : i + len(out)]) * m
    return out


def _exact(data: np.ndarray, length: int) -> np.ndarray:
    """Code of each window of up to eight bytes: the bytes themselves."""
    out = np.zeros(len(data) - length + 1, np.uint64)
    for i in range(length):
        out = (out << np.uint64(8)) | data[i : i + len(out)]
    return out


class Patterns:
    """Distinct, non-empty patterns."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = sorted(set(patterns), key=lambda p: (len(p), p))
        self.multiplier = _multiplier(self.patterns)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p in self.patterns}):
            numbers = np.array([i for i, p in enumerate(self.patterns) if len(p) == length])
            content = np.frombuffer(b"".join(self.patterns[i] for i in numbers), np.uint8).reshape(-1, length)
            codes = np.array([self._codes(row, length)[0] for row in content], np.uint64)
            order = np.argsort(codes)
            self.by_length[length] = codes[order], numbers[order], content[order]

    def _codes(self, data: np.ndarray, length: int) -> np.ndarray:
        return _exact(data, length) if length <= EXACT else _polynomial(data, length, self.multiplier)

    def found(self, column: pa.Array, step: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct ``(row, pattern number)`` of the patterns each text contains, block by block.

        With ``step`` a pattern starts at a multiple of so many bytes into its text. Null texts contain nothing.
        """
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if starts[-1] > starts[0] else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            # At least one row, then as many as a block holds.
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK, side="right")) - 1)
            yield self._block(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first], first, step)
            first = last

    def _block(self, data: np.ndarray, starts: np.ndarray, first: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        n, found = len(self.patterns), [np.zeros(0, np.int64)]
        for length, (codes, numbers, content) in self.by_length.items():
            for begin in range(0, len(data) - length + 1, BLOCK):
                piece = data[begin : begin + BLOCK + length - 1]
                windows = self._codes(piece, length)
                place = np.minimum(np.searchsorted(codes, windows), len(codes) - 1)
                at = np.flatnonzero(codes[place] == windows)
                place = place[at]
                if length > EXACT:
                    same = (piece[at[:, None] + np.arange(length)] == content[place]).all(axis=1)
                    at, place = at[same], place[same]
                at = at + begin
                row = np.searchsorted(starts, at, side="right") - 1
                inside = at + length <= starts[row + 1]
                if step > 1:
                    inside &= (at - starts[row]) % step == 0
                found.append(np.unique(row[inside] * n + numbers[place[inside]]))
        keys = np.unique(np.concatenate(found))
        return keys // n + first, keys % n
