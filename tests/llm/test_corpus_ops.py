"""Source divergence, target resampling and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import quadtree
from packetloom.llm.byte_words import LETTERS_AND_DIGITS, word_blocks
from packetloom.llm.exact_dedup import exact_groups, without_duplicates
from packetloom.llm.source_audit import divergence_audit
from packetloom.llm.target_resampling import feature_codes, gain_planes, importance_sample, plane_sums

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- exact duplicates


def grouped(rows: list[tuple]) -> list[tuple]:
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for row, text in zip(rows, texts):
        groups[text].append(row[0])
    smallest = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        [(r[0], smallest[t], len(groups[t]), r[0] == smallest[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, texts)],
        key=repr,
    )


ODD = [
    (5, "a  b", "x", "s"), (3, "a\tb", "x", "s"), (9, "a\x0b\r\nb", None, None), (7, "ab", "x", "s"), (8, None, "x", "s"),
    (2, "", "x", "s"), (4, " ", "x", "s"), (6, "\n\n", "x", "s"), (11, "a b", "x", "s"), (3, "a\tb", "x", "s"),
    (None, "lonely", "x", "s"), (None, "ab", "x", "s"), (20, "w" * 300_000, "x", "s"), (19, "w" * 300_000, "x", "s"),
]


@pytest.mark.parametrize("digest", [None, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2)), lambda c: F.unhex(F.lit("00"))])
def test_exact_groups(spark, digest):
    rows = ODD + [(100 + i, f"text {i % 40}", "x", "s") for i in range(300)] + [(1000 + i, "hot text", "x", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    # Extra columns with clashing names do no harm.
    for name in ("digest", "salt", "n", "keep_id", "group", "id"):
        docs = docs.withColumn(name, F.lit(1))
    extra = {} if digest is None else {"digest": digest}
    got = exact_groups(docs, salts=3, **extra).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()
    wanted = grouped(rows)
    if digest is None:
        assert sorted([(*r[:4], bytes(r[4]).hex()) for r in got], key=repr) == wanted
    else:
        assert sorted([tuple(r[:4]) for r in got], key=repr) == sorted([r[:4] for r in wanted], key=repr)


def test_exact_groups_of_an_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_dedup_runs_no_python(spark):
    plan = exact_groups(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_without_duplicates(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    stay = sorted((r["doc_id"], r["text"]) for r in without_duplicates(docs).where("doc_id is not null").collect())
    assert [r[0] for r in stay] == [2, 3, 3, 4, 7, 11, 19]


# --- target resampling


def features(text: str | None) -> tuple[list[str], list[bytes]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [" ".join(words[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def sampled(docs: list[tuple], target: list[str | None], percent: int = 5, buckets: int = 10_000) -> list[tuple]:
    per_doc = [features(t) for _, t in docs]
    s = Counter(zlib.crc32(f) % buckets for _, fs in per_doc for f in fs)
    t = Counter(zlib.crc32(f) % buckets for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (words, fs) in zip(docs, per_doc):
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(fs), weight, score, len(words)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {r[0]: k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted([(*r[:4], rank.get(r[0]) if r[4] >= 20 else None) for r in out], key=repr)


def test_features_and_planes():
    rng = random.Random(5)
    texts = [None, "", " ", "A b-C", "Ünï Ég x1 9", "a" * 5000 + " b", " \x7f\x00ab"]
    texts += ["".join(rng.choice("abAB09 .é日\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    gains = np.array([rng.randint(-9000, 9000) for _ in range(10_000)])
    for column, part in ((pa.array(texts), texts), (pa.array(texts).slice(3, 200), texts[3:203])):
        seen = 0
        for begin, end, owner, codes, words in word_blocks(column, LETTERS_AND_DIGITS, 7):
            rows, crcs = feature_codes(owner, codes, words)
            counts = np.zeros((end - begin, 10_000), np.uint16)
            np.add.at(counts, (rows, crcs % 10_000), 1)
            sums = plane_sums(counts, gain_planes(gains))
            for i in range(end - begin):
                wanted = features(part[begin + i])[1]
                assert sorted(crcs[rows == i].tolist()) == sorted(zlib.crc32(f) for f in wanted)
                assert sums[i] == sum(gains[zlib.crc32(f) % 10_000] for f in wanted)
                seen += 1
        assert seen == len(part)


def test_planes_of_extreme_gains():
    for gains in ([0, 0], [-8, 7], [-1, -1], [4, -5], [2**20, -(2**20)]):
        counts = np.array([[0, 0], [1, 0], [0, 3], [255, 254]], np.uint8)
        assert plane_sums(counts, gain_planes(np.array(gains))).tolist() == (counts.astype(int) @ np.array(gains)).tolist()


def test_importance_sample(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, None), (-2, ""), (-3, "..."), (None, "one two " * 30), (-4, "x" * 200_000 + " long"), (-5, "word " * 70_000)]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(0)).withColumn("weight", F.lit("w"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_sample(frame, goal).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == sampled(docs, target)
    got = importance_sample(frame, goal.limit(0), percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == sampled(docs, [], 50)


def test_importance_sample_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance_sample(empty, empty).count() == 0


# --- source divergence


def audited(rows: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    def sort_key(r):
        return (-r[1], r[0].encode())

    per_lang, out = defaultdict(list), []
    for _, text, lang, source in rows:
        per_lang[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))))
    for lang, docs in per_lang.items():
        seen = Counter(t for _, words in docs for t in set(words))
        terms = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for source, words in docs:
            counts[source].update(w for w in words if seen[w] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = c.total() + len(terms)
            return [1 + 10**9 * (c[t] + 1) // total for t in terms]

        q, of = shares(whole), {a: shares(c) for a, c in counts.items()}
        for a in counts:
            pairs = [(b, sum((x - y) ** 2 // y for x, y in zip(of[a], of[b]))) for b in counts if b != a]
            more = [(t, (x - y) ** 2 // y) for t, x, y in zip(terms, of[a], q) if counts[a][t] and x > y]
            out += [(lang, a, "pair", i, v, k) for k, (i, v) in enumerate(sorted(pairs, key=sort_key), 1)]
            out += [(lang, a, "term", i, v, k) for k, (i, v) in enumerate(sorted(more, key=sort_key)[:top], 1)]
    return sorted(out)


def test_divergence_audit(spark):
    rng = random.Random(2)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rows += [(0, None, None, None), (1, "x Y étÉ", None, "s"), (2, "y y x", "", None), (3, "x y", None, "t"), (4, "", "zz", "only")]
    rows += [(5, "a b", "two", "p"), (6, "c d", "two", "q")] * 2
    # More sources than a tile has rows, more terms than a unit has columns.
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(1500)]
    rows += [(100 + i, " ".join(rng.choices(names, k=200)), "wide", f"s{i % 70}") for i in range(210)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).withColumn("value", F.lit(3))
    assert sorted(map(tuple, divergence_audit(docs).collect())) == audited(rows)
    assert sorted(map(tuple, divergence_audit(docs, least_docs=1, top=3).collect())) == audited(rows, 1, 3)


def test_divergence_audit_of_an_empty_table(spark):
    assert divergence_audit(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_joint_traversal(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 40)), int(rng.integers(1, 200))
    empty = rng.integers(1, 50, n)
    matrix = np.repeat(empty[:, None], width, axis=1)
    cells = rng.random((n, width)) < rng.choice([0, 0.02, 0.3, 1])
    matrix[cells] = rng.integers(1, 10**9, cells.sum())
    rows, cols = np.nonzero(cells)
    split = int(rng.integers(0, n)) if seed % 3 == 0 else 0
    got = quadtree.pair_sums(rows, cols, matrix[rows, cols], empty, width, split)
    for a in range(n):
        for b in range(n):
            if a != b and (not split or (a < split) != (b < split)):
                assert got[a, b] == ((matrix[a] - matrix[b]) ** 2 // matrix[b]).sum()
