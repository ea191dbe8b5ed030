"""Expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature width in bytes, and per-flow widths.
FEATURE_BYTES = 1024
ROW_BYTES = 64
ROWS_PER_FLOW = 4


def zeros(n: int) -> Column:
    return F.lit(bytes(n))


def hex_text(b: Column | str) -> Column:
    """Lower-case hex of a binary column."""
    return F.lower(F.hex(b))


def from_hex(text: Column | str, on_odd: str = "error") -> Column:
    """Hex text to bytes.

    Of an odd number of digits, ``on_odd="nibble"`` reads the last digit as a byte of its own
    (``abc`` is AB 0C) and ``"error"`` fails the query.
    """
    text = F.col(text) if isinstance(text, str) else text
    odd = F.length(text) % 2 == 1
    if on_odd == "nibble":
        split = F.length(text) - 1
        fixed = F.concat(text.substr(F.lit(1), split), F.lit("0"), text.substr(split + 1, F.lit(1)))
        return F.unhex(F.when(odd, fixed).otherwise(text))
    if on_odd == "error":
        return F.when(odd, F.raise_error(F.lit("odd number of hex digits"))).otherwise(F.unhex(text))
    raise ValueError(f"on_odd must be 'error' or 'nibble', not {on_odd!r}")


def byte_length(b: Column | str) -> Column:
    return F.octet_length(b)


def head(b: Column, n: int) -> Column:
    """At most the first ``n`` bytes."""
    return F.substring(b, 1, n)


def crop_and_pad(b: Column, width: int = FEATURE_BYTES) -> Column:
    """Exactly ``width`` bytes: cut, or filled up with zeros."""
    return F.rpad(b, F.lit(width), zeros(1))


def cropped_length(b: Column, width: int = FEATURE_BYTES) -> Column:
    """Length of the real content left by :func:`crop_and_pad`."""
    return F.least(F.octet_length(b), F.lit(width)).cast("long")


def byte_values(b: Column) -> Column:
    """Bytes as an array of integers 0..255.

    Read as Latin-1 every byte is the character of its own number, so one split gives them all.
    """
    chars = F.split(F.decode(b, "ISO-8859-1"), "")
    values = F.transform(chars, lambda c: F.ascii(c))
    return F.when(F.octet_length(b) == 0, F.array().cast("array<int>")).otherwise(values)


def overwrite_zero(b: Column, start: Column, n: int) -> Column:
    """``n`` bytes from the 1-based ``start`` set to zero; shorter input is left as it is."""
    return F.when(F.octet_length(b) >= start + (n - 1), F.overlay(b, zeros(n), start, F.lit(n))).otherwise(b)


def uint(b: Column, start: Column | int, n: int) -> Column:
    """Big-endian unsigned integer in ``n`` (at most 7) bytes from the 1-based ``start``; null beyond the end."""
    start = F.lit(start) if isinstance(start, int) else start
    piece = b.substr(start, F.lit(n))
    return F.when(F.octet_length(b) >= start + (n - 1), F.conv(F.hex(piece), 16, 10).cast("long"))
