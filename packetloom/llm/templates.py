"""Benchmark items in documents, found by templates in which numbers, names and units are slots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import blocks, buffers, kept, lean, text_of

WINDOW = 8
LITERALS = 4  # words of a window that are no slots, at least
BLOCK_BYTES = 4 << 20
SHARE = 0.5  # of an item's windows, for a document to hold the item
FILTER_BITS = 1 << 22
STEP = np.uint64(0x9E3779B97F4A7C15)
# Units that become slots.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces ton tons "
    "ml cl dl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar k c f celsius fahrenheit usd eur gbp "
    "dollar dollars euro euros cent cents percent kmh mph".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
MEASURE = re.compile(r"([+-]?\d[\d.,]*)([a-z°]+)")
EDGE = " \t.,;:!?\"'()[]{}<>*#&|_~`“”‘’«»…-"


def canonical(word: str, begins: bool) -> tuple[str, str]:
    """(what stands in the template, what fills the slot) of a word; ``begins`` if it begins a sentence."""
    bare = word.strip(EDGE)
    low = bare.lower()
    if NUMBER.fullmatch(bare) or low in NUMBER_WORDS:
        return "<number>", low
    if (m := MEASURE.fullmatch(low)) and m[2].strip("°") in UNITS:
        return "<measure>", low
    if low in UNITS and len(low) > 1:
        return "<unit>", low
    if not begins and bare[:1].isupper() and bare[1:].islower() and len(bare) > 1:
        return "<name>", low
    return low, ""


class _Words(dict):
    """Numbers words, and keeps for each its two template codes and whether a sentence ends with it."""

    def __init__(self):
        super().__init__()
        self.codes, self.slots, self.ends = [], [], []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        for begins in (True, False):
            shown, _ = canonical(word, begins)
            self.codes.append(xxhash.xxh64_intdigest(shown) if shown else 0)
            self.slots.append(shown[:1] == "<")
        self.ends.append(word.rstrip("\"')]}*#&%$”’»")[-1:] in ".!?:")
        return n


Read = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]


def read(texts: list[str], words: _Words) -> Iterator[Read]:
    """For each text, per word that holds more than punctuation: template code, slot flag, place, sentence begin; and all its words."""
    found = [t.split() for t in texts]
    numbers = [np.fromiter(map(words.__getitem__, f), np.int64, len(f)) for f in found]
    ends, codes, slots = np.array(words.ends, bool), np.array(words.codes, np.uint64), np.array(words.slots, bool)
    for own, number in zip(found, numbers):
        begins = np.ones(len(own), bool)
        begins[1:] = ends[number[:-1]]
        at = 2 * number + ~begins
        real = np.flatnonzero(codes[at])
        yield codes[at][real], slots[at][real], real, begins[real], own


def windows(codes: np.ndarray, slots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``width`` words with enough literal ones, and where they begin."""
    if len(codes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(codes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ codes[k : k + n]) * STEP
        out ^= out >> np.uint64(29)
    literal = np.concatenate([[0], np.cumsum(~slots)])
    good = literal[width:] - literal[:-width] >= min(LITERALS, width)
    return out[good], np.flatnonzero(good)


def _fillers(found: list[str], places: list[int], begins: list[bool]) -> list[str]:
    return [canonical(found[p], b)[1] for p, b in zip(places, begins)]


_ROW = [("id", pa.int64()), ("pos", pa.int32()), ("code", pa.int64()), ("width", pa.int32()), ("fill", pa.list_(pa.string()))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 5, _ROW)], names=[n for n, _ in _ROW])


def _rows(doc_id: int | None, hits: np.ndarray, codes: np.ndarray, width: int, read_: Read) -> list[tuple]:
    _, _, real, begins, found = read_
    return [
        (doc_id, int(p), int(np.int64(c.view(np.int64))), width, _fillers(found, real[p : p + width].tolist(), begins[p : p + width].tolist()))
        for p, c in zip(hits.tolist(), codes)
    ]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item; an item shorter than a window is one window."""
    for batch in batches:
        rows = []
        for item, own in zip(batch.column("id").to_pylist(), read(batch.column("text").to_pylist(), _Words())):
            width = min(WINDOW, len(own[0]))
            if width:
                codes, places = windows(own[0], own[1], width)
                rows += _rows(item, places, codes, width, own)
        yield _batch(rows)


def _doc_windows(batches: Iterator[pa.RecordBatch], known: np.ndarray, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Windows of documents whose hash the filter knows; all others are no item's."""
    bits = np.unpackbits(known).view(bool)
    words = _Words()
    for batch in batches:
        rows = []
        ids, texts = batch.column("id").to_pylist(), batch.column("text")
        for begin, end in blocks(np.diff(buffers(texts)[1]), BLOCK_BYTES):
            if len(words) > 1 << 18:
                words = _Words()
            for doc_id, own in zip(ids[begin:end], read(texts[begin:end].to_pylist(), words)):
                for width in widths:
                    codes, places = windows(own[0], own[1], width)
                    hit = bits[(codes >> np.uint64(42)).astype(np.int64)]
                    if hit.any():
                        rows += _rows(doc_id, places[hit], codes[hit], width, own)
        if rows:
            yield _batch(rows)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[(batch.column("code").to_numpy().view(np.uint64) >> np.uint64(42)).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


_SCHEMA = "id long, pos int, code long, width int, fill array<string>"


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_windows, n_found, coverage, reworded``: benchmark items that documents hold.

    Words become a template: numbers, units and (inside a sentence) capitalised names are slots.
    Windows of 8 words with 4 literal ones at least meet by hash, item against document; shorter items
    are one window. Slots must be consistent: on one alignment of item and document the same filler
    stands for the same filler throughout, as when a question is asked again with other numbers. A
    document holds an item if its consistent alignments have ``share`` of the item's, each counted
    once however often the document repeats it.
    ``reworded`` is true if fillers differ. Items whose windows are all slots can't be found.

    A filter of fixed size (512 kB) of the items' hashes drops windows in the scan; the rest is a hash
    join, so the benchmark may grow. A window that many items share is joined to each distinct filler.
    Null and empty texts hold nothing; repeated rows and ids give one row for each pair; rows without
    an id are left out; other columns are not read.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("long").alias("id"), text_of(text).alias("text")).where("id is not null").dropDuplicates(["id"])
    own = kept(wanted.mapInArrow(_item_windows, _SCHEMA), "item_windows")
    known = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in own.select("code").coalesce(4).mapInArrow(_bits, "bits binary").collect():
        known |= np.frombuffer(row.bits, np.uint8)
    widths = [r.width for r in own.select("width").distinct().orderBy("width").collect()]  # at most WINDOW values
    sent = spark.sparkContext.broadcast(known)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text")).where("id is not null")
    found = rows.mapInArrow(lean(lambda it: _doc_windows(it, sent.value, widths)), _SCHEMA).distinct()
    mine = own.select(F.col("id").alias("item"), F.col("pos").alias("at"), "code", "width", F.col("fill").alias("theirs"))
    met = found.join(mine, ["code", "width"]).withColumn("shift", F.col("pos") - F.col("at"))
    met = kept(met.select("id", "item", "shift", "at", "width", "fill", "theirs"), "met", texts=True)
    # In an alignment each slot filler of the item must always stand for one filler, and the other way round.
    pairs = met.select("id", "item", "shift", F.explode(F.arrays_zip("theirs", "fill")).alias("p")).where("p.theirs != ''")
    pairs = pairs.select("id", "item", "shift", F.col("p.theirs").alias("a"), F.col("p.fill").alias("b")).distinct()
    clashes = (
        pairs.groupBy("id", "item", "shift", "a").count().where("count > 1").select("id", "item", "shift")
        .unionByName(pairs.groupBy("id", "item", "shift", "b").count().where("count > 1").select("id", "item", "shift"))
        .distinct()
    )
    changed = pairs.where("a != b").select("id", "item", "shift").distinct().withColumn("reworded", F.lit(True))
    total = own.groupBy(F.col("id").alias("item")).agg(F.count("*").alias("n_windows"))
    good = met.join(clashes, ["id", "item", "shift"], "left_anti").join(changed, ["id", "item", "shift"], "left")
    # Words put in or left out change the alignment in the middle of an item: alignments add up, each window of the item once.
    summed = good.groupBy("id", "item").agg(F.countDistinct("at").alias("n_found"), F.max(F.coalesce("reworded", F.lit(False))).alias("reworded")).join(total, "item")
    out = summed.withColumn("coverage", F.col("n_found") / F.col("n_windows")).where(F.col("coverage") >= share)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_found", "coverage", "reworded")
