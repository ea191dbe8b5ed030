"""Near copies, passages, repeats and templates against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import graph, passages, simhash, suffix_dedup, templates

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A b c d e"), (5, "a B c d e"), (6, "x" * 30000), (7, "w " * 9000), (None, "A b c d e")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).isEmpty()


@pytest.mark.parametrize("n", [3, 40, 600])
def test_index_links_all_near_codes(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(1, n // 20)).astype(np.uint64)
    codes = base[rng.integers(0, len(base), n)].copy()
    for _ in range(5):
        codes ^= (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    near = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    assert simhash.classes(codes, 4).tolist() == roots(len(codes), near.tolist())


def brute_groups(rows):
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    pairs = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if (a ^ b).bit_count() <= 4]
    root, least = roots(len(rows), pairs), {}
    for (d, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, root)), key=repr)


@pytest.mark.parametrize("hot", [8192, 3])
def test_simhash_groups(spark, documents, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = [tuple(r) for r in documents.collect()] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows)
    assert simhash.simhash_groups(df.where("false")).isEmpty()


def test_one_of_each_group_of_near_copies_stays(spark):
    rnd = random.Random(2)
    word = lambda: f"{rnd.getrandbits(30):x}"
    base = [word() for _ in range(300)]
    near = [*base[:150], "edit", *base[151:]]
    rows = [(9, base), (4, near), (5, base), (6, base[:100] + [word() for _ in range(200)]), (None, base), (7, []), (8, [])]
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows] + [(4, " ".join(near), "x")], "doc_id long, text string, key string")
    got = simhash.without_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [4, 6, 7]


@pytest.mark.parametrize("hot", [8192, 30])
def test_all_candidates_for_near_copies_are_compared(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(3)
    word = lambda: f"{rnd.getrandbits(30):x}"
    base, texts = [word() for _ in range(200)], []
    for _ in range(80):
        changed = set(rnd.sample(range(200), rnd.randint(2, 4)))
        texts.append(" ".join(word() if n in changed else w for n, w in enumerate(base)))
    sets = [set(simhash.shingles(t.encode(), simhash.NEAR_WIDTH)) for t in texts]
    prints = np.array([simhash.fingerprints(t.encode(), simhash.NEAR_WIDTH) for t in texts]).view(np.uint64)
    pairs = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if np.bitwise_count(prints[i] ^ prints[j]).min() <= simhash.NEAR_DISTANCE and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.without_near_copies(df).collect())
    want = sorted(set(roots(len(texts), pairs)))
    assert got == want and 1 < len(want) < len(texts) - 10


def brute_repeats(rows, width):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if data[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(data[i : i + width])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((d, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_covers():
    for period, cover in suffix_dedup.COVERS.items():
        assert len({(a - b) % period for a in cover for b in cover}) == period


@pytest.mark.parametrize("width", [4, 25, 100])
def test_repeats(spark, width, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    rnd = random.Random(width)
    base = ["".join(rnd.choice("ab \n") for _ in range(rnd.choice([0, 3, 30, 200, 700]))) for _ in range(12)]
    rows = [(i, "".join(rnd.sample(base, rnd.randint(0, 3))) + rnd.choice(["", "x", "é"])) for i in range(40)]
    rows += [(100, None), (200, base[3] * 2), (201, base[3] * 2), (300, "z" * 5000), (300, "z" * 5000), (None, "z" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(0))
    cut = suffix_dedup.remove_repeats(df, width)
    got = cut.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, width)
    assert suffix_dedup.remove_repeats(df.where("false"), width).isEmpty()


def test_repeats_in_documents(spark, documents):
    cut = suffix_dedup.remove_repeats(documents, 100)
    got = cut.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats([tuple(r) for r in documents.collect()], 100)


def test_chains_are_collinear_and_best_first():
    left, right = np.array([0, 5, 10, 3, 50, 15]), np.array([100, 105, 110, 400, 7, 115])
    found = passages.chains(left, right)
    assert [left[i] for i in found[0]] == [0, 5, 10, 15]
    assert sorted(i for c in found for i in c) == list(range(6))


def test_passages(spark):
    rnd = random.Random(5)
    words = lambda n: [f"{rnd.getrandbits(30):x}" for _ in range(n)]
    p = words(80)
    fuzzy = [x if i % 12 else "edit" for i, x in enumerate(p)]
    texts = [(1, words(100) + p + words(50)), (2, words(30) + p), (3, words(60) + fuzzy + words(9)), (4, words(150)), (5, p[:30] + words(90)), (6, words(20) + p[:40] + words(3) + p[40:])]
    rows = [(i, " ".join(w)) for i, w in texts] + [(7, None), (8, ""), (9, " ".join(texts[0][1])), (9, " ".join(texts[0][1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("begin", F.lit(1))
    got = passages.shared_passages(df).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} >= {(2, 1), (3, 1), (6, 1), (9, 1)}
    assert {r["doc_id"] for r in got} == {2, 3, 6, 9}
    two = next(r for r in got if (r["doc_id"], r["other_id"]) == (2, 1))
    assert (two["begin"], two["end"], two["other_begin"], two["other_end"], two["similarity"]) == (30, 110, 100, 180, 1.0)
    assert sum(r["doc_id"] == 9 and r["other_id"] == 1 for r in got) == 2
    assert passages.shared_passages(df.where("false")).isEmpty()


@pytest.mark.parametrize("partners", [4, 1])
def test_passages_whose_parts_stand_elsewhere(spark, partners, monkeypatch):
    monkeypatch.setattr(passages, "PARTNERS", partners)
    rnd = random.Random(7)
    words = lambda n: [f"{rnd.getrandbits(30):x}" for _ in range(n)]
    p = words(65)
    parts = {1: p[:25], 2: p[19:45], 3: p[39:], 8: p, 9: p, 10: p[:25], 11: p[19:45], 12: p[39:]}
    df = spark.createDataFrame([(i, " ".join(words(40) + w + words(40))) for i, w in parts.items()], "doc_id long, text string")
    got = [(r["doc_id"], r["other_id"], r["begin"], r["end"], r["similarity"]) for r in passages.shared_passages(df).collect()]
    assert got == [(9, 8, 40, 105, 1.0)]


def test_passages_among_many_texts_with_the_same_seeds(spark):
    rnd = random.Random(8)
    words = lambda n: [f"{rnd.getrandbits(30):x}" for _ in range(n)]
    begin, end, middle = words(18), words(18), words(24)
    edited = ["edit" if i in (0, 6, 12, 18, 23) else w for i, w in enumerate(middle)]
    held = {i: words(24) for i in [*range(1, 31), *range(100, 131)]} | {50: middle, 51: edited}
    df = spark.createDataFrame([(i, " ".join(words(40) + begin + m + end + words(40))) for i, m in held.items()], "doc_id long, text string")
    got = [(r["doc_id"], r["other_id"], r["begin"], r["end"]) for r in passages.shared_passages(df).collect()]
    assert got == [(51, 50, 40, 100)]


def test_longest_common_subsequence():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
        return row[-1]

    rnd = random.Random(9)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(150))] for _ in "ab")
        assert passages._longest_common(a, b) == brute(a, b)


def test_passages_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(passages, "OUT_ROWS", 3, raising=False)
    text = " ".join(f"w{i}" for i in range(80)).encode()
    chains = pa.array([[{"left": [10, 60], "right": [10, 60]}]] * 10, pa.list_(pa.struct([("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))])))
    ids = pa.array(range(10), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, ids, pa.array([text] * 10), pa.array([text] * 10), chains], names=["later", "earlier", "doc_id", "other_id", "a", "b", "chains"])
    out = list(passages._compared(iter([batch]), 50, 0.8))
    assert sum(b.num_rows for b in out) == 10 and max(b.num_rows for b in out) == 3
    assert {tuple(r.values())[3:] for b in out for r in b.to_pylist() if r["doc_id"] == 4} == {(0, 80, 4, 0, 80, 80, 1.0)}


def test_pairs_of_long_texts_come_in_small_batches(spark, monkeypatch):
    found = passages._compared

    def watched(batches, *how):
        def small(batches):
            for batch in batches:
                assert batch.num_rows < 2 or batch.nbytes < 3 << 20
                yield batch

        return found(small(batches), *how)

    monkeypatch.setattr(passages, "_compared", watched)
    rnd = random.Random(10)
    words = lambda n: [f"{rnd.getrandbits(30):x}" for _ in range(n)]
    p = words(80)
    df = spark.createDataFrame([(i, " ".join(words(20_000) + p)) for i in range(15)], "doc_id long, text string").repartition(1)
    assert {(r["doc_id"], r["other_id"]) for r in passages.shared_passages(df).collect()} >= {(i, 0) for i in range(1, 15)}


def test_repeated_seeds_meet_as_runs():
    rnd = random.Random(11)

    def side():
        codes = [c for _ in range(30) for c in [rnd.randrange(6)] * rnd.choice([1, 1, 2, 9])]
        return np.array(codes, np.int64), np.cumsum([rnd.choice([1, 1, 2, 30]) for _ in codes]).astype(np.int32)

    for _ in range(40):
        (a, x), (b, y) = side(), side()
        i, j = np.nonzero(a[:, None] == b[None])
        got, every = passages.Segments(a, x).met(passages.Segments(b, y)), passages.Runs.of(x[i].astype(np.int64), y[j].astype(np.int64))
        assert all((getattr(got, c) == getattr(every, c)).all() for c in "xyuvn")
    # One seed 20 000 times in both texts: as many runs as there are distances, not 400 million anchors.
    text = passages.Segments(np.zeros(20_000, np.int64), np.arange(20_000, dtype=np.int32))
    assert len(text.met(text).x) == 39_999


def test_seeds_of_texts_in_a_row():
    rnd = random.Random(12)
    texts = [np.array([rnd.randrange(9) for _ in range(n)], np.uint64) for n in (0, 3, 6, 7, 9, 10, 0, 11, 200, 5, 6)]
    text, place, name = passages.seeds(np.concatenate(texts), np.array([len(t) for t in texts]))
    for i, own in enumerate(texts):
        _, at, names = passages.seeds(own, np.array([len(own)]))
        assert (place[text == i] == at).all() and (name[text == i] == names).all()
        n = len(own) - passages.SEED_WORDS + 1
        mers = {p: passages.seeds(own[p : p + passages.SEED_WORDS], np.array([passages.SEED_WORDS]))[2][0] for p in range(n)}
        width = min(passages.SPARSE, n)
        assert at.tolist() == sorted({min(range(p, p + width), key=lambda k: mers[k]) for p in range(n - width + 1)} if n > 0 else [])


def test_passages_of_one_word_again_and_again(spark):
    rows = [(1, " ".join(["the"] * 300)), (2, " ".join(["x"] * 9 + ["the"] * 70)), (3, "the end " * 200)]
    got = {(r["doc_id"], r["other_id"], r["begin"], r["end"], r["other_begin"]) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= {(2, 1, 9, 79, 0), (2, 1, 9, 79, 230)} and {g[:2] for g in got} == {(2, 1)}


def test_passages_of_texts_that_are_only_the_earlier_ones_so_far(spark):
    rnd = random.Random(13)
    words = lambda n: [f"{rnd.getrandbits(30):x}" for _ in range(n)]
    p = words(65)
    # Texts 1 to 3 have the parts first, so 8 and 9 meet 10, the last, and not each other.
    parts = {1: p[:25], 2: p[19:45], 3: p[39:], 8: p, 9: p, 10: p}
    df = spark.createDataFrame([(i, " ".join(words(40) + w + words(40))) for i, w in parts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"], r["begin"], r["end"]) for r in passages.shared_passages(df).collect()}
    assert got == {(9, 8, 40, 105), (10, 8, 40, 105), (10, 9, 40, 105)}


def test_passages_at_two_places_of_an_earlier_text(spark):
    rnd = random.Random(14)
    words = lambda n: [f"{rnd.getrandbits(30):x}" for _ in range(n)]
    p = words(60)
    texts = {1: words(20) + p + words(200) + p + words(9), 2: words(30) + p + words(30)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = sorted((r["doc_id"], r["other_id"], r["begin"], r["end"], r["other_begin"]) for r in passages.shared_passages(df).collect())
    assert got == [(2, 1, 30, 90, 20), (2, 1, 30, 90, 280)]


def test_passages_uncovered_in_the_middle_only(spark):
    rnd = random.Random(15)
    words = lambda n: [f"{rnd.getrandbits(30):x}" for _ in range(n)]
    before, p, after = words(45), words(50), words(45)
    head, tail = before + p[:20], p[30:] + after
    texts = {1: head, 2: tail, 3: words(30) + p + words(30), 4: before + p + after}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"], r["begin"], r["end"]) for r in passages.shared_passages(df).collect()}
    assert got == {(4, 1, 0, 65), (4, 2, 75, 140), (4, 3, 45, 95)}


def test_templates(spark):
    asked = "We know that Anna has 12 apples and gives 5 apples to Bob at noon today in the park."
    rows = [
        (1, asked), (2, f"x {asked.replace('Anna', 'Carl').replace('Bob', 'Dora').replace('12', '7')} y"),
        (3, asked.replace("Anna", "Carl").replace("Bob", "Carl")), (4, None), (5, ""), (None, asked), (6, "Nothing of the kind is asked here at all today."), (1, asked),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(3))
    items = spark.createDataFrame([(9, asked), (8, None), (7, "short one"), (7, "short one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in templates.contaminated(docs, items).collect()}
    assert got == {(1, 9): False, (2, 9): True}
    assert templates.contaminated(docs.where("false"), items).isEmpty()
    assert templates.contaminated(docs, items.where("false")).isEmpty()


def test_a_repeated_line_is_one_window(spark):
    item = "please read all of these terms with care because they bind every reader from the first day"
    line = " ".join(item.split()[:8])
    rows = [(1, " and then it said again ".join([line] * 9)), (2, item), (3, f"{item} or so {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = templates.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_windows"], r["n_found"], r["coverage"]) for r in got.collect()) == [(2, 10, 10, 1.0), (3, 10, 10, 1.0)]


def test_benchmark_passages_in_documents(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(d, r["item_id"]) for r in items.collect() for d, t in documents.collect() if r["text"] in t}
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(documents, items).collect()}
    assert whole <= got
