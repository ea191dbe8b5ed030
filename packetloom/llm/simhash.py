"""Near copies by SimHash, found through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept, lean, text_key
from packetloom.llm.graph import components

SEED = 42
BITS = 64
LEAF = 32
HOT = 8192  # members of one upper node that a task takes together
FRONTIER = 1 << 18


def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles of lower-cased text, repeats included; all words if there are fewer."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; zero without words."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, width)), np.uint64)
    sums = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 4096):
        part = hashes[begin : begin + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def masks(distance: int) -> list[int]:
    """Bit masks such that codes within ``distance`` agree on all bits of one of them.

    The bits fall into ``distance + 2`` blocks, of which such codes share two.
    """
    edges = [BITS * i // (distance + 2) for i in range(distance + 3)]
    part = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(part, 2)]


class Index:
    """Codes in Gray order; each node keeps the bits that all codes below it share, as mask and pattern.

    A level halves the nodes of the one below. A parent's mask lies within its children's, so a child
    adds only the differences on the bits that it factors out beyond its parent: differences of a
    query accumulate from the root down, and a node whose sum passes the limit goes with all below it.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        starts = np.arange(0, len(codes), LEAF)
        ones, zeros = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
        self.levels = []
        while True:
            self.levels.append((~(ones ^ zeros), ones & ~(ones ^ zeros)))
            if len(ones) == 1:
                break
            pair = np.arange(0, len(ones), 2)
            ones, zeros = np.bitwise_and.reduceat(ones, pair), np.bitwise_or.reduceat(zeros, pair)
        self.levels.reverse()

    def near(self, begin: int, end: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i in [begin, end) and j > i, of codes that differ in at most ``limit`` bits."""
        query = np.arange(begin, end)
        node, sums = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        above = np.zeros(len(query), np.uint64)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                query, node, sums, above = (np.repeat(x, 2) for x in (query, node * 2, sums, above))
                node[1::2] += 1
                width = (LEAF << (len(self.levels) - 1 - depth))
                there = (node < len(mask)) & ((node + 1) * width > query)
                query, node, sums, above = query[there], node[there], sums[there], above[there]
            own = mask[node]
            sums = sums + np.bitwise_count((self.codes[query] ^ pattern[node]) & own & ~above)
            keep = sums <= limit
            query, node, sums, above = query[keep], node[keep], sums[keep], own[keep]
        i = np.repeat(query, LEAF)
        j = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        there = (j > i) & (j < len(self.codes))
        i, j = i[there], j[there]
        near = np.bitwise_count(self.codes[i] ^ self.codes[j]) <= limit
        return i[near], j[near]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking places i and j: the smallest place of each class so far."""
    while len(i):
        a, b = label[i], label[j]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(again := label[label], label):
            label = again
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
    return label


def classes(codes: np.ndarray, limit: int) -> np.ndarray:
    """For each of the codes in Gray order, the first place that links reach from it."""
    label, index = np.arange(len(codes)), Index(codes)
    step = max(LEAF, FRONTIER // max(LEAF, len(codes)))
    for begin in range(0, len(codes), step):
        label = _join(label, *index.near(begin, min(begin + step, len(codes)), limit))
    return label


def _small(codes: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """As ``classes`` for many groups of up to ``LEAF`` codes at once: leaves without upper nodes."""
    label = np.arange(len(codes))
    for step in range(1, LEAF):
        i = np.flatnonzero(group[step:] == group[:-step]) if len(group) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(codes[i] ^ codes[i + step]) <= limit]
        label = _join(label, i, i + step)
    return label


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links from each code to the first of its class, within the groups of rows sorted by group."""

    def found(codes: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        number = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])) if len(group) else group
        size = np.bincount(number)
        order = np.lexsort((gray_rank(codes), number))
        codes, label = codes[order], np.arange(len(codes))
        few = size[number] <= LEAF
        label[few] = np.flatnonzero(few)[_small(codes[few], number[few], limit)]
        ends = np.cumsum(size)
        for g in np.flatnonzero(size > LEAF):
            begin = ends[g] - size[g]
            label[begin : ends[g]] = begin + classes(codes[begin : ends[g]], limit)
        linked = label != np.arange(len(label))
        signed = codes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], names=["u", "v"])

    codes, group = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        codes = np.concatenate([codes, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        group = np.concatenate([group, batch.column("node").to_numpy(zero_copy_only=False)])
        whole = int(np.flatnonzero(group == group[-1])[0]) if len(group) else 0
        if whole:
            yield found(codes[:whole], group[:whole])
            codes, group = codes[whole:], group[whole:]
    if len(codes):
        yield found(codes, group)


def near_fingerprints(codes: DataFrame, distance: int = 4) -> DataFrame:
    """Links ``u, v`` that connect all distinct codes (column ``fp``) within ``distance`` bits.

    The upper nodes of the index are the bit patterns of ``masks``: rows meet by hash of (mask,
    pattern). A node of more than ``HOT`` codes is cut into hashed parts, and every two parts meet in
    a task, so no task holds more than two of them. In a task each node has the codes below it as an
    ``Index``; only a link to the first code of its class leaves it for each code.
    """
    shared = F.array(*[F.struct(F.lit(n).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> 63 else m)).alias("bits")) for n, m in enumerate(masks(distance))])
    rows = codes.select("fp", F.explode(shared).alias("s")).select("fp", F.xxhash64("s.mask", "s.bits").alias("node"))
    size = rows.groupBy("node").count().where("count > 1")
    hot = kept(size.where(F.col("count") > HOT).select(F.col("node").alias("hot"), F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "hot_nodes")
    if not hot.isEmpty():
        rows = rows.join(hot, F.col("node") == F.col("hot"), "left")
        part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("node", F.least(part, other), F.greatest(part, other)))
        rows = rows.select("fp", F.explode(F.when(F.col("parts").isNull(), F.array("node")).otherwise(pairs)).alias("node"))
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "node").sortWithinPartitions("node").mapInArrow(lambda it: _links(it, distance), "u long, v long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id``: the smallest id that links of near fingerprints reach.

    Texts are lower-cased (A to Z) and cut at ASCII white space; a fingerprint comes from shingles of
    ``width`` words. Texts that are null or have no word have fingerprint zero, linked like any other.
    Rows may repeat; null ids get their component's smallest id, null if there is none. Other columns
    are not read. Copies share a fingerprint, so only distinct fingerprints are linked.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = kept(rows.mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long"), "fingerprints")
    codes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "codes")
    roots = components(near_fingerprints(codes.select("fp"), distance))
    rooted = codes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    labelled = kept(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("code"), "component_id"), "components")
    out = prints.join(labelled, F.col("fp") == F.col("code"), "left")
    return out.select("doc_id", "fp", F.format_string("%016x", F.col("fp")).alias("fingerprint"), "component_id")


PRINTS = 4
RECENT = 128
NEAR_WIDTH = 5
NEAR_DISTANCE = 8
MIX = tuple(int(x) for x in np.random.default_rng(1).integers(1, 1 << 62, PRINTS) * 2 + 1)


def fingerprints(text: bytes, width: int) -> list[int]:
    """``PRINTS`` independent fingerprints from one hash of each shingle."""
    return _mixed(shingles(text, width))


def _mixed(found: list[bytes]) -> list[int]:
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64)
    out = []
    for factor in MIX:
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(BITS, np.int64)
        for begin in range(0, len(mixed), 4096):
            sums += np.unpackbits(mixed[begin : begin + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(sums * 2 > len(mixed), bitorder="little").view("<i8")[0]))
    return out


def _many(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, size = [], []
        for text in batch.column("text").cast(pa.large_binary()):
            found = shingles(text.as_py() or b"", width)
            prints.append(_mixed(found))
            size.append(len(set(found)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints, pa.list_(pa.int64())), pa.array(size, pa.int64())], names=["row", "prints", "size"])


def near_pairs(codes: np.ndarray, group: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places i < j of codes of one group within ``limit``, in parts; codes are sorted by group and Gray rank."""
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    few = np.flatnonzero(size[group] <= LEAF) if len(group) else np.zeros(0, np.int64)
    c, g = codes[few], group[few]
    for step in range(1, LEAF):
        i = np.flatnonzero(g[step:] == g[:-step]) if len(g) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(c[i] ^ c[i + step]) <= limit]
        yield few[i], few[i + step]
    ends = np.cumsum(size)
    for n in np.flatnonzero(size > LEAF):
        begin, end = int(ends[n] - size[n]), int(ends[n])
        index = Index(codes[begin:end])
        step = max(LEAF, FRONTIER // max(LEAF, end - begin))
        for first in range(0, end - begin, step):
            i, j = index.near(first, min(first + step, end - begin), limit)
            yield i + begin, j + begin


def nearest(codes: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code, sorted by group and Gray rank, the place of the nearest earlier one within ``limit``, or -1.

    Also, for each code, whether it is in a pair within ``limit`` that these places don't name.
    """
    best, at, more = np.full(len(codes), limit + 1), np.full(len(codes), -1), np.zeros(len(codes), bool)
    for i, j in near_pairs(codes, group, limit):
        d = np.bitwise_count(codes[i] ^ codes[j])
        order = np.lexsort((i, d, j))
        i, j, d = i[order], j[order], d[order]
        lead = np.concatenate([[True], j[1:] != j[:-1]]) if len(j) else np.zeros(0, bool)
        more[i[~lead]] = more[j[~lead]] = True
        i, j, d = i[lead], j[lead], d[lead]
        better = d < best[j]
        other = np.where(better, at[j], i)
        more[other[other >= 0]] = more[j[other >= 0]] = True
        best[j[better]], at[j[better]] = d[better], i[better]
    return at, more


def _whole_nodes(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns, the last of them the node, of whole nodes, from rows sorted by node."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in columns]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        whole = int(np.flatnonzero(held[-1] == held[-1][-1])[0]) if len(held[-1]) else 0
        if whole:
            yield [x[:whole] for x in held]
            held = [x[whole:] for x in held]
    if held and len(held[-1]):
        yield held


def _by_gray(node: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by node and Gray rank of rows sorted by node, and the node's number for each row."""
    group = np.cumsum(np.concatenate([[0], (node[1:] != node[:-1]).astype(np.int64)]))
    return np.lexsort((gray_rank(codes), group)), group


def _candidates(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Each text's nearest earlier one in each of its nodes; null beside texts in other pairs within ``limit``."""
    for rows, codes, node in _whole_nodes(batches, ["row", "code", "node"]):
        codes = codes.view(np.uint64)
        order, group = _by_gray(node, codes)
        rows = rows[order]
        at, more = nearest(codes[order], group, limit)
        linked, also = at >= 0, np.unique(rows[more])
        u, v = np.maximum(rows[linked], rows[at[linked]]), np.minimum(rows[linked], rows[at[linked]])
        none = pa.nulls(len(also), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, also])), pa.concat_arrays([pa.array(v), none])], names=["u", "v"])


def _unlinked(batches: Iterator[pa.RecordBatch], limit: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """All pairs within ``limit`` of different classes, but those whose sizes alone keep them below ``similarity``.

    A pair comes from the first of the nodes that the two codes share.
    """
    every = np.array(masks(limit), np.uint64)
    for rows, codes, size, root, mask, node in _whole_nodes(batches, ["row", "code", "size", "root", "mask", "node"]):
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        mixed = np.repeat(mixed, np.diff(np.append(starts, len(node))))
        rows, codes, size, root, mask, node = (x[mixed] for x in (rows, codes.view(np.uint64), size, root, mask, node))
        if not len(rows):
            continue
        order, group = _by_gray(node, codes)
        rows, codes, size, root, mask = (x[order] for x in (rows, codes, size, root, mask))
        for i, j in near_pairs(codes, group, limit):
            keep = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
            i, j = i[keep], j[keep]
            for n, bits in enumerate(every):
                earlier = (mask[i] > n) & ((codes[i] ^ codes[j]) & bits == 0)
                i, j = i[~earlier], j[~earlier]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rows[i], rows[j])), pa.array(np.minimum(rows[i], rows[j]))], names=["u", "v"])


def _at_nodes(codes: DataFrame, distance: int, *columns: str) -> DataFrame:
    """``columns`` of ``codes`` (``row, n, code`` and others) or ``mask``, and ``node``, for each node of a code; sorted by node.

    A node of more than ``HOT`` rows is cut into hashed parts, of which every two meet.
    """
    shared = F.array(*[F.struct(F.lit(k).cast("long").alias("mask"), F.col("code").bitwiseAND(F.lit(m - (1 << BITS) if m >> 63 else m)).alias("bits")) for k, m in enumerate(masks(distance))])
    rows = codes.select("*", F.explode(shared).alias("s")).select("*", "s.mask").select(*columns, F.xxhash64("n", F.col("s.mask").cast("int"), "s.bits").alias("node"))
    size = rows.groupBy("node").count()
    hot = kept(size.where(F.col("count") > HOT).select(F.col("node").alias("hot"), F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "hot_nodes")
    if not hot.isEmpty():
        rows = rows.join(hot, F.col("node") == F.col("hot"), "left")
        part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("node", F.least(part, other), F.greatest(part, other)))
        rows = rows.select(*columns, F.explode(F.when(F.col("parts").isNull(), F.array("node")).otherwise(pairs)).alias("node"))
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "node").sortWithinPartitions("node")


def _verified(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    known: dict[int, set] = {}  # the texts met last: a text has several candidates

    def own(row: int, text: pa.Scalar) -> set:
        if row not in known:
            if len(known) >= RECENT:
                del known[next(iter(known))]
            known[row] = set(shingles((text.as_py() or "").encode(), width))
        return known[row]

    for batch in batches:
        keep = []
        for u, v, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("a"), batch.column("b")):
            s, t = own(u, a), own(v, b)
            both = len(s & t)
            keep.append(not (s or t) or both >= similarity * (len(s) + len(t) - both))
        links = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"])
        yield links.filter(pa.array(keep, pa.bool_()))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = NEAR_WIDTH, similarity: float = 0.8, distance: int = NEAR_DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id (null ids last).

    Near copies share ``similarity`` of their distinct shingles of ``width`` words, or are linked
    through others that do. Equal texts collapse first. Candidates come from four fingerprints within
    ``distance`` bits: the patterns of ``masks`` are the upper nodes of a Gray-order index for each.
    First each text meets its nearest earlier one in each node and the two are compared by their shingles;
    then all other candidates whose texts are not linked yet, so that no candidate is left out. Four
    fingerprints find 99 % of pairs of similarity 0.9 and five in six of 0.8. Texts that are null or
    have no word are near copies of each other. Columns stay as they are, whatever their names.
    """
    columns = docs.columns
    first = [F.col(doc_id).isNull().alias("c0"), F.col(doc_id).alias("c1"), *[F.col(c).alias(f"c{n + 2}") for n, c in enumerate(columns)]]
    grouped = docs.groupBy(text_key(text).alias("key")).agg(F.min(F.struct(*first)).alias("r"))
    back = [F.col(f"r.c{n + 2}").alias(c) for n, c in enumerate(columns)]
    texts = kept(grouped.select(F.monotonically_increasing_id().alias("__row"), F.struct(*back).alias("__doc")), "texts", texts=True)
    own = texts.select(F.col("__row").alias("row"), F.col("__doc").getField(doc_id).alias("id"), F.col("__doc").getField(text).alias("text"))
    prints = kept(own.select("row", "text").mapInArrow(lean(lambda it: _many(it, width)), "row long, prints array<long>, size long"), "prints", texts=True)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        with_a = pairs.join(own.select(F.col("row").alias("u"), F.col("text").alias("a")), "u")
        with_b = with_a.join(own.select(F.col("row").alias("v"), F.col("text").alias("b")), "v")
        return kept(with_b.select("u", "v", "a", "b").mapInArrow(lean(lambda it: _verified(it, width, similarity)), "u long, v long"), name, texts=True)

    codes = prints.select("row", F.posexplode("prints").alias("n", "code"))
    near = _at_nodes(codes, distance, "row", "code").mapInArrow(lean(lambda it: _candidates(it, distance)), "u long, v long")
    near = kept(near.distinct(), "candidates")
    roots = components(linked(near.where("v IS NOT NULL"), "near"))
    # Texts in other pairs too, with their classes: only pairs of different classes can add a link.
    rest = prints.join(near.where("v IS NULL").select(F.col("u").alias("row")), "row", "left_semi")
    rest = rest.join(roots, F.col("row") == F.col("node"), "left").select("row", "prints", "size", F.coalesce("root", "row").alias("root"))
    rest = kept(rest, "rest")
    codes = rest.select("row", "size", "root", F.posexplode("prints").alias("n", "code"))
    others = _at_nodes(codes, distance, "row", "code", "size", "root", "mask").mapInArrow(lean(lambda it: _unlinked(it, distance, similarity)), "u long, v long")
    others = kept(others.distinct(), "others").join(near, ["u", "v"], "left_anti")
    more = linked(others, "more")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    member = own.select("id", "row").join(roots, F.col("row") == F.col("node"))
    best = member.groupBy("root").agg(F.min(order).alias("best"))
    losers = kept(member.join(best, "root").where(F.col("row") != F.col("best.row")).select(F.col("row").alias("lost")), "losers")
    return texts.join(losers, F.col("__row") == F.col("lost"), "left_anti").select("__doc.*")
