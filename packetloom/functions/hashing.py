"""Seeded hashes of a row id, the source of every random choice in the library.

A choice is a pure function of ``(seed, id)``: a retried task, a lost executor or a second
evaluation of the plan picks the same rows, and so does any other engine with md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str | Column, *ids: str | Column) -> Column:
    """md5 of ``seed:id:id...`` as 32 lower-case hex digits; a null id leaves its place empty."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    parts = [seed, *[F.col(i) if isinstance(i, str) else i for i in ids]]
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def bernoulli(h: Column, fraction: float) -> Column:
    """True for the given fraction of hashes."""
    if fraction >= 1:
        return F.lit(True)
    if fraction <= 0:
        return F.lit(False)
    return F.substring(h, 1, 8) < F.lit(f"{math.floor(fraction * 2**32):08x}")


def hash_number(h: Column) -> Column:
    """The first 15 digits of a hash as an integer in [0, 2**60)."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
