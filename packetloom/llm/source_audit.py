"""How the sources of a language differ in their terms: exact divergences by a K-squared tree over group-term counts.

Per language, the matrix has a row for each source and a column for each kept term, frequent terms first, so
that the rare ones, most of whose cells are zero, lie together. It is cut into units of 1024 columns and two
tiles of 32 rows; each is a tree of its own (`quadtree`), and all pairs of rows descend it together: quadrants
that are all zero for both are priced from the two rows' empty cells without opening them, the other leaves cell
by cell. The sums of the units are added up per pair. All figures are whole numbers.

Texts are read once and shuffled as counts per (language, source, term). A hot language spreads over its terms;
a hot source has no more cells than there are terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.byte_words import LETTERS, word_blocks
from packetloom.llm.common import kept, text_of
from packetloom.llm.quadtree import pair_sums
from packetloom.operators.ranking import numbered_within

SCALE = 1_000_000_000
COLUMNS = 1024
TILE = 32
LEAST_DOCS = 3
TOP = 200


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (1, 2))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for begin, end, owner, codes, words in word_blocks(batch.column(0), LETTERS):
                if not len(codes):
                    continue
                size = len(words)
                in_doc, times = np.unique(owner * size + codes, return_counts=True)
                keys = group[begin:end][in_doc // size] * size + in_doc % size
                cells, cell = np.unique(keys, return_inverse=True)
                n = np.zeros(len(cells), np.int64)
                np.add.at(n, cell, times)
                columns = [
                    langs.dictionary.take(pa.array(cells // size // len(sources.dictionary))),
                    sources.dictionary.take(pa.array(cells // size % len(sources.dictionary))),
                    words.take(pa.array(cells % size)).cast(pa.binary()).cast(pa.string()),
                    pa.array(n),
                    pa.array(np.bincount(cell)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns[:3]] + columns[3:], ["lang", "source", "term", "n", "docs"])

    slim = docs.select(text_of(text).alias("text"), text_of(lang).alias("lang"), text_of(source).alias("source"))
    counts = slim.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), in decimals: exact however large the counts."""
    over = f"cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))"
    return F.expr(f"1 + (({over}) div cast({total} + {terms} as decimal(20,0)))")


def _unit_sums(key: tuple, cells: pa.Table) -> pa.Table:
    """Sums of one unit, for each ordered pair of its rows. Rows with column -1 carry the price of an empty cell."""
    lang, _, low, high = (k.as_py() for k in key)
    gid, col, p, width = (cells.column(c).to_numpy() for c in ("gid", "col", "p", "width"))
    # Both tiles of a unit next to each other, the first one full.
    row = np.where(gid // TILE == low, gid % TILE, TILE + gid % TILE) if low != high else gid % TILE
    marker = col < 0
    empty = np.ones(int(row[marker].max()) + 1, np.int64)
    empty[row[marker]] = p[marker]
    split = TILE if low != high else 0
    sums = pair_sums(row[~marker], col[~marker], p[~marker], empty, int(width[0]), split)
    first, second = np.nonzero(~np.eye(len(empty), dtype=bool))
    if split:
        across = (first < split) != (second < split)
        first, second = first[across], second[across]
    gids = np.where(np.arange(len(empty)) < TILE, low * TILE, high * TILE - TILE) + np.arange(len(empty))
    return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "a": gids[first], "b": gids[second], "value": sums[first, second]})


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for ordered pairs of groups of a language that has terms.

    ``cells`` is ``lang, gid, col, p``, ``groups`` ``lang, gid, empty, v, tiles``.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(v - 1) div {COLUMNS}")))
    markers = groups.where("v > 0").select("lang", "gid", F.lit(-1).cast("long").alias("col"), F.col("empty").alias("p"), "v", "tiles", blocks.alias("block"))
    inner = cells.select("lang", "gid", (F.col("col") % COLUMNS).alias("col"), "p", "v", "tiles", F.expr(f"col div {COLUMNS}").alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    tiled = inner.unionByName(markers).select("*", F.expr(f"gid div {TILE}").alias("tile"), other.alias("other"))
    units = tiled.select(
        "lang",
        "block",
        F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
        "gid",
        "col",
        "p",
        F.least(F.lit(COLUMNS).cast("long"), F.col("v") - F.col("block") * COLUMNS).alias("width"),
    )
    sums = units.groupBy("lang", "block", "low", "high").applyInArrow(_unit_sums, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence_audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the others of its language, and in what.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps those in at least
    ``least_docs`` of its documents. Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms
    that a source has more often than its language. Ranks go by value, the largest first, then by item.

    Null texts, languages and sources count as empty ones, and an empty name is a name like others. A group whose
    texts are all empty takes part in pairs; in a language without kept terms all pairs have value 0. Repeated
    rows count each. Other columns are not looked at. An empty table gives no rows.
    """
    names = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct()
    groups = kept(numbered_within(kept(names, "groups"), ["lang"], [F.col("source").asc()], "gid", start=0), "groups")
    counts = kept(term_counts(docs, lang, source, text), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    terms = kept(terms.where(F.col("docs") >= least_docs).drop("docs"), "terms")
    columns = kept(numbered_within(terms, ["lang"], [F.col("total").desc(), F.col("term").asc()], "col", start=0), "columns")
    counted = kept(counts.drop("docs").join(columns, ["lang", "term"]), "cells")

    langs = columns.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_total"))
    tiles = groups.groupBy("lang").agg((F.expr(f"max(gid) div {TILE}") + 1).alias("tiles"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    sized = groups.join(tiles, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    empty = F.when(F.col("v") > 0, F.expr(f"1 + ({SCALE} div nullif(group_total + v, 0))"))
    sized = kept(sized.withColumn("empty", empty), "group-sizes")

    priced = counted.join(sized, ["lang", "source"]).select(
        "lang", "source", "gid", "term", "col", "v", "tiles", share("n", "group_total", "v").alias("p"), share("total", "lang_total", "v").alias("q")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    more = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    more = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    values = kept(pair_values(priced.select("lang", "gid", "col", "p", "v", "tiles"), sized), "pair-values")
    one, two = (sized.select("lang", F.col("source").alias(s), F.col("gid").alias(g)) for s, g in (("source", "a"), ("item", "b")))
    pairs = one.join(two, "lang").where("a <> b").join(values, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*order).union(more.withColumn("part", F.lit("term")).select(*order))
