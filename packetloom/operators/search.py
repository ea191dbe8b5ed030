"""Which rows contain which templates."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.octets import hex_text
from packetloom.functions.patterns import Patterns
from packetloom.operators.stored import attach, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Blocks of the seed join; a template needs twice the length less one to cover a whole block.
BLOCK = 16

# Bytes of shorter templates that are looked for in one pass.
CHUNK_BYTES = 1 << 20


def contains_hex(packet: Column, needle: str, byte_aligned: bool = False) -> Column:
    """True if the hex form of a binary column contains the digits.

    Without alignment a match may start in the middle of a byte, and the number of digits may be
    odd.
    """
    text = hex_text(packet)
    needle = needle.lower()
    if byte_aligned:
        return text.rlike(f"^(?:[0-9a-f]{{2}})*?{needle}")
    return text.contains(needle)


def matches(
    texts: DataFrame,
    text_id: list[str],
    text: str,
    templates: DataFrame,
    template_id: list[str],
    template: str,
    byte_aligned: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Pairs of ids where the text contains the template, literally: ``text_id, template_id``.

    Templates of 31 characters or more meet the texts by an equi-join: texts are cut into consecutive blocks of 16
    characters, of which such a template covers a whole one, at one of 16 offsets. Blocks of a text add up to its own
    size, and only their hashes and the ids are joined; the texts found are then checked with ``contains``.

    Shorter templates select too little for a join. Each text looks for all of them at once (`functions.patterns`), in
    place: nothing is shuffled but what is found. Templates go to the tasks in chunks of about ``chunk_bytes``, one
    pass over the texts for each chunk.

    Ids of the two sides must have different names. Null and empty templates are left out. With
    ``byte_aligned`` both sides are lower-case hex, and a match starts at a whole byte.
    """
    known = stored(templates.where(F.length(template) > 0).select(*template_id, F.col(template).alias("_t")), "templates")
    is_long = F.length("_t") >= 2 * BLOCK - 1
    found = [_long_matches(texts, text_id, text, known.where(is_long), template_id, byte_aligned)] if not known.where(is_long).isEmpty() else []
    found += [
        _short_matches(texts, text_id, text, chunk, byte_aligned) for chunk in _chunks(known.where(~is_long), chunk_bytes)
    ]
    if not found:
        return texts.select(*text_id).join(known.select(*template_id), F.lit(False))
    short = [attach(f, known, ["_t"], null_keys=False).select(*text_id, *template_id) for f in found if "_t" in f.columns]
    return reduce(DataFrame.unionByName, [f for f in found if "_t" not in f.columns] + short)


def _chunks(short: DataFrame, chunk_bytes: int) -> Iterator[list[bytes]]:
    """Distinct texts of the templates, by number of a chunk; the driver holds one chunk at a time."""
    distinct = short.select("_t").distinct()
    n_bytes = distinct.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    chunks = -(-n_bytes // chunk_bytes)
    if chunks == 1:
        yield [r[0].encode() for r in distinct.collect()]
        return
    for i in range(chunks):
        part = [r[0].encode() for r in distinct.where(F.pmod(F.xxhash64("_t"), F.lit(chunks)) == i).collect()]
        if part:
            yield part


def _short_matches(texts: DataFrame, text_id: list[str], text: str, chunk: list[bytes], byte_aligned: bool) -> DataFrame:
    """``text_id, _t``, each once."""
    patterns = Patterns(chunk)
    names = pa.array([p.decode() for p in patterns.patterns])
    slim = texts.select(*text_id, F.col(text).alias("_t"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.select(text_id)
            for rows, numbers in patterns.found(batch.column(len(text_id)), 2 if byte_aligned else 1):
                picked = ids.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*picked.columns, names.take(pa.array(numbers))], [*text_id, "_t"])

    return slim.mapInArrow(search, slim.schema)


def _long_matches(
    texts: DataFrame, text_id: list[str], text: str, known: DataFrame, template_id: list[str], byte_aligned: bool
) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(1), F.lit(BLOCK)))
    seeds = known.withColumn("_o", starts).select(*template_id, F.xxhash64(F.substring("_t", F.col("_o"), F.lit(BLOCK))).alias("_k"))
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{{BLOCK}}}"), F.lit(0))
    pieces = F.array_distinct(F.transform(blocks, lambda piece: F.xxhash64(piece)))
    hashed = texts.where(F.length(text) >= 2 * BLOCK - 1).select(*text_id, F.explode(pieces).alias("_k"))
    met = hashed.join(stored(seeds.distinct(), "template-seeds"), "_k").select(*text_id, *template_id).distinct()
    candidates = attach(stored(met, "match-candidates"), known, template_id, null_keys=False)
    whole = texts.select(*text_id, F.col(text).alias("_x"))
    found_in = F.col("_x").contains(F.col("_t"))
    if byte_aligned:
        found_in = found_in & F.rlike("_x", F.concat(F.lit("^(?:[0-9a-f]{2})*?"), "_t"))
    checked = whole.join(stored(candidates, "match-candidates"), text_id).where(found_in)
    return checked.select(*text_id, *template_id)
