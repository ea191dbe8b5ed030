"""Exact largest inner products by KD-trees, one per shard of the vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import kept

LEAF = 64
# Sums of products of whole numbers below this are exact as doubles.
EXACT = 2.0**53
LONG = (1 << 63) - 1
MOST = float(np.finfo(np.float64).max)
SHARD_BYTES = 48 << 20
QUERY_BLOCK = 256


class Tree:
    """Median splits along the widest side; each node has the tight box of its vectors.

    Vectors are whole numbers held as doubles. Sums of products stay exact below 2**53; where they may be larger,
    doubles only bound nodes, with room for their rounding, and candidates are scored in Python's whole numbers.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.arange(len(ids))
        self.low, self.high, self.span, self.children = [], [], [], []
        if len(ids):
            self._node(0, len(ids))
        self.low, self.high = (np.array(x).reshape(len(self.span), -1) for x in (self.low, self.high))
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.largest = np.maximum(np.abs(self.low), np.abs(self.high)) if len(ids) else self.low

    def _node(self, begin: int, end: int) -> int:
        me, part = len(self.span), self.vectors[self.order[begin:end]]
        low, high = part.min(0), part.max(0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((begin, end))
        self.children.append(())
        if end - begin > LEAF and (high > low).any():
            middle = (end - begin) // 2
            side = np.argpartition(part[:, int(np.argmax(high - low))], middle)
            self.order[begin:end] = self.order[begin:end][side]
            self.children[me] = (self._node(begin, begin + middle), self._node(begin + middle, end))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest product that each query can have within each node's box; a little more where doubles round."""
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
            reach = np.abs(queries) @ self.largest.T
            most = np.where(reach < EXACT, most, most + reach * (queries.shape[1] * 2.0**-50))
        return np.nan_to_num(most, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def scores(self, begin: int, end: int, vector: np.ndarray, exact: bool) -> np.ndarray:
        """Products with some vectors; those that no long holds count as the nearest that it does."""
        if exact:
            return self.vectors[begin:end] @ vector
        whole = [int(q) for q in vector]
        sums = [sum(q * int(x) for q, x in zip(whole, row)) for row in self.vectors[begin:end]]
        return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], object)

    def best(self, own: int, vector: np.ndarray, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """Up to ``k`` (score, id), none below ``least``; ties go to smaller ids.

        Nodes are visited best bound first until no bound can reach the k-th score so far, which
        starts from what another shard has found (``least``).
        """
        with np.errstate(over="ignore"):
            exact = not len(bounds) or bool(np.abs(vector) @ self.largest[0] < EXACT)
        if not exact:
            least = float(np.nextafter(least, -np.inf))  # a score beyond 2**53 may have been rounded up
        found: list[tuple[int, int]] = []  # a heap, the worst first: (score, -id)
        todo = [(-bounds[0], 0)] if len(bounds) else []
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            begin, end = self.span[node]
            scores = self.scores(begin, end, vector, exact)
            for i in np.flatnonzero(scores >= least):
                entry = (int(scores[i]), -int(self.ids[begin + i]))
                if -entry[1] == own:
                    continue
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
                if len(found) == k:
                    least = max(least, found[0][0])
        return [(score, -negative) for score, negative in found]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of one or more shards in order, in each its vectors first and then blocks of queries."""
    shard, ids, vectors, tree = None, [], [], None
    for batch in batches:
        out = []
        for at, kind, row_ids, data, least in zip(*[batch.column(c).to_pylist() for c in ("shard", "kind", "ids", "data", "least")]):
            if at != shard:
                shard, ids, vectors, tree = at, [], [], None
            n = np.frombuffer(row_ids, np.int64)
            x = np.frombuffer(data, np.float64).reshape(len(n), -1)
            if kind == 0:
                ids.append(n)
                vectors.append(x)
                continue
            if tree is None:
                tree = Tree(np.concatenate(ids), np.concatenate(vectors)) if ids else Tree(np.zeros(0, np.int64), np.zeros((0, x.shape[1])))
                ids, vectors = [], []
            bounds = tree.bounds(x) if len(tree.span) else np.zeros((len(n), 0))
            for i, threshold in enumerate(np.frombuffer(least, np.float64)):
                out += [(int(n[i]), there, score) for score, there in tree.best(int(n[i]), x[i], bounds[i], k, threshold)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])


def _packs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of (n, id, vector, least) as blocks of up to ``size`` vectors of one length and shard."""
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = batch.column("vector")
        lengths = np.array([len(v) for v in vectors])
        out = []
        for key in sorted(set(zip(shard.tolist(), lengths.tolist()))):
            rows = np.flatnonzero((shard == key[0]) & (lengths == key[1]))
            for begin in range(0, len(rows), size):
                pick = rows[begin : begin + size]
                flat = vectors.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                out.append((key[0], key[1], ids[pick].tobytes(), flat.tobytes(), least[pick].tobytes()))
        if out:
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["shard", "width", "ids", "data", "least"])


_PACK = "shard long, width int, ids binary, data binary, least binary"


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``id, vector`` with floor(scale * x) as doubles, which hold each such number as it is.

    Rows without an id, and vectors null, empty or with a component null or not finite, are left out. A component
    that is finite but not when scaled counts as the largest double of its sign.
    """
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.greatest(F.least(v * scale, F.lit(MOST)), F.lit(-MOST)))
    # From 2**53 on every double is a whole number.
    whole = F.transform(scaled, lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v))
    return df.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & finite).select(F.col(vec_id).cast("long").alias("id"), whole.alias("vector"))


def top_products(df: DataFrame, queries_every: int, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query row.

    Queries are the rows whose id ``queries_every`` divides, candidates all rows with another id.
    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id. Vectors are cut into shards
    of bounded size, each with a KD-tree. Queries meet the shards in packed blocks, in two rounds:
    first each query in one shard, then with the k-th score found there as its bound in all others.

    Rows with a null id, and null, empty or not finite vectors, take no part; only vectors of equal
    length meet. Scores are exact whatever the components' size; one that no long holds counts, and is
    returned, as the largest or smallest long. Rows that repeat an id are
    candidates each; a query id counts once (its smallest vector). Other columns are not read.
    """
    spark = df.sparkSession
    vectors = kept(integer_vectors(df, vec_id, embedding, scale), "vectors")
    n_bytes = vectors.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    n_shards = max(4, -(-int(n_bytes) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("id", "vector"), F.lit(n_shards))
    candidates = vectors.select(shard.alias("shard"), "id", "vector", F.lit(0.0).alias("least")).mapInArrow(lambda it: _packs(it, 4096), _PACK)
    wanted = vectors.where(F.col("id") % queries_every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    wanted = kept(wanted.withColumn("home", F.pmod(F.xxhash64("id"), F.lit(n_shards))), "queries")

    def searched(queries: DataFrame) -> DataFrame:
        blocks = queries.mapInArrow(lambda it: _packs(it, QUERY_BLOCK), _PACK)
        both = candidates.withColumn("kind", F.lit(0)).unionByName(blocks.withColumn("kind", F.lit(1)))
        both = both.repartition(n_shards, "shard", "width").sortWithinPartitions("shard", "width", "kind")
        one = both.withColumn("shard", F.struct("shard", "width").cast("string")).select("shard", "kind", "ids", "data", "least")
        return one.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")

    first = kept(searched(wanted.select(F.col("home").alias("shard"), "id", "vector", F.lit(float("-inf")).alias("least"))), "near")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    bounded = wanted.join(kth.withColumnRenamed("query_id", "id"), "id", "left")
    every = bounded.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "id", "vector", "home", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"))
    rest = searched(every.where("shard != home").select(F.col("shard").cast("long").alias("shard"), "id", "vector", "least"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
