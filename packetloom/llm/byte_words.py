"""Words of many texts at once: runs of allowed bytes in an Arrow column, as numbers into a table of distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from packetloom.llm.common import blocks, buffers

BLOCK_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LETTERS_AND_DIGITS = LETTERS.copy()
LETTERS_AND_DIGITS[48:58] = True


def word_blocks(
    column: pa.Array, allowed: np.ndarray, rows: int = 1 << 30
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Rows ``begin`` to ``end`` in blocks of bounded bytes, each with the row (from 0) and the number of
    every word in turn, and the distinct words, in which only A-Z are lower-cased.

    A longer text is a block of its own. Nulls and empty texts have no words. Words never cross rows.
    """
    data, starts = buffers(column)
    for begin, end in blocks(np.diff(starts), BLOCK_BYTES):
        for first in range(begin, end, rows):
            last = min(first + rows, end)
            yield first, last, *_words(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first], allowed)


def _words(data: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = allowed[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    offsets = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins, out=offsets[1:])
    letters = LOWER[data[inside[1:-1]]]
    runs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )
    coded = runs.dictionary_encode()
    owner = np.searchsorted(starts, begins, side="right") - 1
    return owner, coded.indices.to_numpy().astype(np.int64), coded.dictionary
