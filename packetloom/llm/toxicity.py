"""Toxic text by compression distance: windows squeezed with a toxic and an ordinary dictionary."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept, lean, step_conf, text_key, text_of

WINDOW_WORDS = 8
LEVEL = 8
ORDINARY_BYTES = 12 << 10
TOXIC_BYTES = 16 << 10
SAMPLE_ROWS = 8000
ODDS = 20.0
CLEAR = (2, 3, 5)
FEATURES = len(CLEAR) + 4
# Of the words that mark toxic texts, and of common words, so many at most are looked at; the dictionaries hold fewer.
MARKERS = TOXIC_BYTES
COMMON = 4 * ORDINARY_BYTES


def windows(text: str) -> list[bytes]:
    """Lower-cased words of the whole text in windows; no word is cut, whatever its length."""
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode() for i in range(0, len(words), WINDOW_WORDS)]


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]*#$%&-")


@dataclass
class Model:
    """Two dictionaries and the calibrated weights of what their lengths say of a text."""

    ordinary: bytes
    toxic: bytes
    weights: list[float] = field(default_factory=list)

    def __post_init__(self):
        self._squeeze = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_squeeze"}

    def __setstate__(self, state):
        self.__dict__.update(state, _squeeze=None)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window beyond the ordinary one."""
        if self._squeeze is None:
            self._squeeze = []
            for content in (self.ordinary, self.toxic):
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=128, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
                known.precompute_compress(compression_params=how)
                self._squeeze.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
        lengths = [np.fromiter(map(len, s.multi_compress_to_buffer(parts, threads=1)), np.int64, len(parts)) for s in self._squeeze] if parts else [np.zeros(0, np.int64)] * 2
        return lengths[0] - lengths[1]

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: how many windows gain so much or more (logarithms) and the share of those that gain a good
        deal, the number of windows, the largest gain, and the gain of all windows over the root of their number."""
        out = np.zeros((len(texts), FEATURES))
        begin, group, parts = 0, [], []

        def flush() -> None:
            gain, at = self.gains(parts), np.cumsum([0, *group])
            for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                own = gain[a:b]
                n, clear = max(len(own), 1), [(own >= g).sum() for g in CLEAR]
                rest = math.log1p(n), math.log1p(100 * clear[1] / n), min(int(own.max(initial=0)), 12), min(own.sum() / math.sqrt(n), 12)
                out[begin + k] = (*np.log1p(clear), *rest)

        for i, text in enumerate(texts):
            own = windows(text)
            group.append(len(own))
            parts += own
            if len(parts) >= 20_000:
                flush()
                begin, group, parts = i + 1, [], []
        if group:
            flush()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.c_[np.ones(len(texts)), self.features(texts)]
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def _signature(words: set[str]) -> bytes:
    return b"".join(sorted(hashlib.md5(w.encode()).digest()[:8] for w in words)[:4])


def _joined(words: list[str], limit: int) -> bytes:
    """Words as dictionary content, the first of the list last, where references are cheapest."""
    out, size = [], 0
    for w in words:
        size += len(w.encode()) + 1
        if size > limit:
            break
        out.append(w)
    return f" {' '.join(reversed(out))} ".encode()


def _heads(word: str) -> list[str]:
    """The beginnings of a word that may mark a text, and the whole word."""
    return [word[:k] for k in range(4, min(len(word), 9))] + [word]


def _strong(toxic: dict[str, int], kept_in: dict[str, int], other: dict[str, int], size: list[int], texts: int) -> dict[str, int]:
    """Word beginnings much commoner in toxic texts, and their occurrences there.

    Rates are of occurrences, so that a word part which both kinds have but one kind repeats counts. Of a
    beginning and a longer one that makes up most of it the longer stays, else the shorter.
    """
    least = max(3, 0.004 * texts)
    chosen = {h for h, n in toxic.items() if kept_in[h] >= least and _likelier(n, other.get(h, 0), size)}
    strong: dict[str, int] = {}
    for h in sorted(chosen, key=lambda h: (-len(h), h)):
        longer = [q for q in strong if q.startswith(h)]
        if not any(strong[q] >= 0.7 * toxic[h] for q in longer):
            strong = {q: n for q, n in strong.items() if not q.startswith(h)} | {h: toxic[h]}
    return strong


def _likelier(n: int, other: int, size: list[int]) -> bool:
    return (n - math.sqrt(n)) * size[0] >= ODDS * (other + 1) * size[1]


def _ranked(words: list[tuple[str, int]], strong: dict[str, int]) -> list[tuple[str, str]]:
    """Words of toxic texts that have a strong beginning, the strongest first, and their ends beyond it."""
    found = []
    for w, n in words:
        if head := next((h for h in reversed(_heads(w)) if h in strong), None):
            found.append((n * len(w), w, w[len(head) :]))
    return [(w, end) for _, w, end in sorted(found, reverse=True)[:MARKERS]]


def _contents(marking: list[tuple[str, str]], common: list[str]) -> Model:
    """A model without weights, from words that mark toxic texts and from common words, the commonest first."""
    taken = {w for w, _ in marking}
    shared = _joined([w for w in common if taken.isdisjoint(_heads(w))], ORDINARY_BYTES)
    ends = list(dict.fromkeys(end for _, end in marking if end))
    return Model(shared + _joined(ends, TOXIC_BYTES), shared + _joined([w for w, _ in marking], TOXIC_BYTES))


def _words(text: str) -> Counter:
    return Counter(filter(None, map(_bare, text.lower().split())))


def _heads_of(words: Counter) -> Counter:
    heads = Counter()
    for w, n in words.items():
        for h in _heads(w):
            heads[h] += n
    return heads


def _halves(signed: list[tuple[bytes, int]]) -> tuple[list[int], list[int]]:
    """Places of the texts that make the dictionaries, and of those that make the weights.

    Near copies, with equal smallest word hashes and label, count once. Few toxic texts serve for both.
    """
    first = list({pair: place for place, pair in reversed(list(enumerate(signed)))}.values())[::-1]
    if sum(signed[i][1] for i in first) < 200:
        return first, first
    return first[::2], first[1::2]


def _dictionaries(counted: list[Counter], labels: list[int]) -> tuple[Model, list[int]]:
    """A model without weights, and the places of the texts that are to make the weights."""
    ours, rest = _halves([(_signature(set(words)), int(label)) for words, label in zip(counted, labels)])
    size = [1 + sum(counted[i].total() for i in ours if labels[i] == kind) for kind in (0, 1)]
    heads, kept_in, words, texts = (Counter(), Counter()), Counter(), Counter(), Counter()
    for i in ours:
        own = _heads_of(counted[i])
        heads[int(labels[i])].update(own)
        texts.update(counted[i].keys())
        if labels[i]:
            kept_in.update(own.keys())
            words.update(counted[i])
    strong = _strong(heads[1], kept_in, heads[0], size, sum(int(labels[i]) for i in ours))
    common = sorted(texts, key=lambda w: (-texts[w], w))[:COMMON]
    return _contents(_ranked(list(words.items()), strong), common), rest


def _weighted(model: Model, features: np.ndarray, kinds: list[int], labels: list[int]) -> Model:
    """``model`` with weights by logistic regression, or those of the shares of ``labels`` if only one kind is there."""
    if len(set(kinds)) < 2:
        model.weights = [math.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 1))] + [0.0] * FEATURES
        return model
    middle, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[np.ones(len(kinds)), (features - middle) / spread]
    y = np.array(kinds, float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (len(w) - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    model.weights = [float(w[0] - (w[1:] * middle / spread).sum()), *(w[1:] / spread).tolist()]
    return model


def fit(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from words that mark either kind of text, then weights by logistic regression.

    Near copies count once: texts with equal smallest word hashes. The ordinary dictionary has the
    commonest words; the toxic one has the same, followed by words much likelier in toxic texts, so
    that lengths differ by what is toxic alone. Half of the texts make the dictionaries, the other
    half the weights (all of them both if there are few).
    """
    model, rest = _dictionaries([_words(t) for t in texts], labels)
    return _weighted(model, model.features([texts[i] for i in rest]), [int(labels[i]) for i in rest], labels)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = [_signature(set(_words(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(signatures, pa.binary())], ["row", "signature"])


def _parted(batches: Iterator[pa.RecordBatch], rows: set[int]) -> Iterator[pa.RecordBatch]:
    """Words, and beginnings of words, of each text of ``rows``, with their occurrences."""
    for batch in batches:
        for row, label, text in zip(batch.column("row").to_pylist(), batch.column("label").to_pylist(), batch.column("text")):
            if row not in rows:
                continue
            words = _words(text.as_py())
            for is_head, parts in ((False, words), (True, _heads_of(words))):
                n = len(parts)
                columns = [pa.array([label] * n, pa.int32()), pa.array([is_head] * n, pa.bool_()), pa.array(list(parts), pa.string()), pa.array(list(parts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "is_head", "part", "n"])


def _featured(batches: Iterator[pa.RecordBatch], model: Model, rows: set[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(row, text.as_py()) for row, text in zip(batch.column("row").to_pylist(), batch.column("text")) if row in rows]
        features = model.features([text for _, text in found]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in found], pa.int64()), pa.array(features, pa.list_(pa.float64()))], ["row", "x"])


def _spark_dictionaries(sample: DataFrame, rows: set[int]) -> Model:
    """What :func:`_dictionaries` makes of the texts of ``rows``, counted by Spark; the driver gets what was chosen."""
    spark = sample.sparkSession
    parts = sample.select("row", "label", "text").mapInArrow(lean(lambda it: _parted(it, rows)), "label int, is_head boolean, part string, n long")
    parts = kept(parts.groupBy("label", "is_head", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")), "word-parts", texts=True)
    words = parts.where("not is_head")
    sums = {r["label"]: r["n"] for r in words.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    size = [1 + sums.get(kind, 0) for kind in (0, 1)]
    n_toxic = sum(r["row"] in rows for r in sample.where("label = 1").select("row").collect())
    toxic = parts.where("is_head and label = 1").select("part", "n", "texts").where(F.col("texts") >= max(3, 0.004 * n_toxic))
    other = parts.where("is_head and label = 0").select("part", F.col("n").alias("other"))
    both = toxic.join(other, "part", "left").na.fill(0, ["other"])
    # The same test as _likelier: only beginnings that pass it reach the driver.
    both = both.where((F.col("n") - F.sqrt("n")) * size[0] >= F.lit(ODDS) * (F.col("other") + 1) * size[1]).collect()
    strong = _strong({r["part"]: r["n"] for r in both}, {r["part"]: r["texts"] for r in both}, {r["part"]: r["other"] for r in both}, size, n_toxic)
    marked: list[tuple[str, int]] = []
    if strong:
        heads = spark.createDataFrame([(h,) for h in strong], "head string")
        begins = F.explode(F.array_distinct(F.array(*[F.substring("part", 1, k) for k in range(4, 9)], F.col("part"))))
        found = words.where("label = 1").select("part", "n", begins.alias("head")).join(heads, "head", "left_semi").select("part", "n").distinct()
        marked = [(r["part"], r["n"]) for r in found.orderBy((F.col("n") * F.length("part")).desc(), F.col("part").desc()).limit(MARKERS).collect()]
    common = words.groupBy("part").agg(F.sum("texts").alias("texts")).orderBy(F.col("texts").desc(), F.col("part").asc()).limit(COMMON)
    return _contents(_ranked(marked, strong), [r["part"] for r in common.collect()])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """As ``fit`` on up to ``rows`` labelled texts whose crc32(id) mod 5 is not 0.

    The sample is chosen by a hash of the id, so that kinds keep their shares. Texts are read whole, in tasks, and
    their words are counted by Spark. The driver gets a signature and a few features of each row of the sample, and of the
    words those that the dictionaries may hold, numbers that the parameters bound whatever the texts' length.
    """
    fold = F.pmod(F.crc32(F.encode(F.col("__id").cast("string"), "utf-8")), F.lit(5))
    known = labels.select(F.col(doc_id).alias("__id"), F.col("toxic").alias("__toxic")).where("__id is not null and __toxic in (0, 1)").where(fold != 0).distinct()
    wanted = known.orderBy(F.xxhash64("__id"), "__id", "__toxic").limit(rows)
    found = docs.select(F.col(doc_id), text_of(text).alias("__text")).join(wanted, F.col(doc_id) == F.col("__id"))
    sample = kept(found.select(F.monotonically_increasing_id().alias("row"), "__id", text_key("__text").alias("key"), F.col("__toxic").cast("int").alias("label"), F.col("__text").alias("text")), "labelled", texts=True)
    with step_conf(docs.sparkSession, texts=True):
        signed = {r["row"]: bytes(r["signature"]) for r in sample.select("row", "text").mapInArrow(lean(_signed), "row long, signature binary").collect()}
    order = sorted(sample.select("row", "__id", "key", "label").collect(), key=lambda r: (hashlib.md5(str(r[1]).encode()).digest(), bytes(r[2]), r[3]))
    ours, rest = _halves([(signed[r["row"]], r["label"]) for r in order])
    model = _spark_dictionaries(sample, {order[i]["row"] for i in ours})
    chosen = {order[i]["row"] for i in rest}
    made = sample.select("row", "text").mapInArrow(lean(lambda it: _featured(it, model, chosen)), "row long, x array<double>")
    with step_conf(docs.sparkSession, texts=True):
        features = {r["row"]: r["x"] for r in made.collect()}
    return _weighted(model, np.array([features[order[i]["row"]] for i in rest]).reshape(-1, FEATURES), [order[i]["label"] for i in rest], [r["label"] for r in order])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` for whole texts.

    Scores depend on the text alone; null and empty texts score as texts without windows. Rows may
    repeat and hold nulls (a null id is not held out); columns named like the new ones are replaced.
    """

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()))

    udf = F.pandas_udf(lean(scored), "double", F.PandasUDFType.SCALAR_ITER)
    fold = F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")), F.lit(5))
    out = docs.withColumn("score", udf(text_of(text)))
    return out.withColumns({"held_out": F.coalesce(fold == 0, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})
