"""MinHash groups, importance resampling and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import minhash, negatives, resampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(400)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, hub string").repartition(parts)


# --- minhash ------------------------------------------------------------------------------------


def shingles(text):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else set(map(lambda w: (w,), words))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = [[rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] for i in range(len(rows))]
    return sorted(((r[0], len(s), min(x, default=None)) for r, s, x in zip(rows, sets, ids, strict=True)), key=repr)


def family_rows(seed, n=70, edits=14):
    """Copies with 0 to ``edits`` changed words of one text: their similarities lie on both sides of 0.8, in chains."""
    rng = random.Random(seed)
    base = rng.choices(VOCAB, k=120)
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(0, edits)):
            words[at] = rng.choice(VOCAB)
        rows.append((rng.randint(0, 10_000) * 100 + i, " ".join(words)))
    return rows


def odd_rows():
    rng = random.Random(5)
    long = " ".join(rng.choices(VOCAB, k=30_000))
    texts = [None, "", " \n\t ", "a", "A", "a b", "a b a b a b", "a b a", "one two three four five six", "ONE two three four five six", "ünï ÄÖ", "Ünï ÄÖ", long, long + " more", "x " * 50]
    rows = [(90 - i, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[8], (None, "one two three four five six"), (None, None), (None, "only this text without an id")]


@pytest.mark.parametrize("rows", [family_rows(1), family_rows(2, edits=20), odd_rows(), [*family_rows(3, 25), *family_rows(4, 25), *odd_rows()]])
@pytest.mark.parametrize("tile", [256, 4])
def test_components(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_no_documents(spark):
    assert minhash.near_duplicates(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_pairs_within_the_distance_meet():
    """Signatures that differ in at most DISTANCE slots share a key; the miss probability is that of the chunks."""
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 16, (300, minhash.SLOTS), dtype=np.uint16)
    for n in (0, 1, 14, minhash.DISTANCE):
        other = one.copy()
        for row in other:
            row[rng.choice(minhash.SLOTS, n, replace=False)] ^= np.uint16(1)
        assert (minhash.chunk_keys(one) == minhash.chunk_keys(other)).any(axis=1).all()
    assert minhash.miss_probability(0.8) < 1e-9 and minhash.miss_probability(1.0) == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    sets = [np.sort(np.concatenate([both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(40)]
    sig = minhash.signatures(sets)
    same = np.mean([(sig[i] == sig[j]).mean() for i in range(40) for j in range(i)])
    assert abs(same - 0.8) < 0.03


# --- resampling ---------------------------------------------------------------------------------

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(rows, target, percent=5, least=20):
    runs = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    count = lambda t: Counter(zlib.crc32(f.encode()) % 10_000 for f in runs(FEATURE_WORD.findall(lowered(t))))
    own, other = [count(t) for _, t in rows], [count(t) for t in target]
    s, t = sum(own, Counter()), sum(other, Counter())
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for (i, text), c in zip(rows, own, strict=True):
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(FEATURE_WORD.findall(lowered(text)))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return out


def resample_rows(n=300, seed=3):
    rng = random.Random(seed)
    words = [*VOCAB[:60], "Été", "straße", "x" * 70, "y" * 200, "l'été", "a-b", "7", "日本語", " ", "k" * 63, "k" * 64, "k" * 65]
    rows = [(3 * i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    return [*rows, (1, None), (2, ""), (4, "... !"), (5, " ".join(rng.choices(words, k=20_000))), (None, " ".join(rng.choices(words, k=30))), (7, "ONE\x00two"), (8, "x" * 100_000)]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resample(spark, percent):
    rows, target = resample_rows(), ["w1 w2 w3 w1 Été", None, "", "w5 " * 40]
    bench = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, doc_id int")
    got = resampling.resample(docs_of(spark, rows), bench, percent).collect()
    expected = [tuple(r[:5]) for r in brute_resample(rows, target, percent)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_resample_repeated_rows_and_nothing(spark):
    rows = [(5, "some words " * 15)] * 10 + [(6, "other words " * 15)] * 10
    bench = spark.createDataFrame([("other",)], "text string")
    got = resampling.resample(docs_of(spark, rows), bench, 50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11)) and {r.doc_id for r in got if r.rank} == {max(got, key=lambda r: r.score).doc_id}
    assert resampling.resample(docs_of(spark, rows).limit(0), bench).count() == 0
    assert resampling.resample(docs_of(spark, rows), bench.limit(0)).count() == 20


def test_checksums_of_long_runs():
    texts = [b"", b"a", b"a b", (b"x" * 300 + b" ") * 5, b"q" * 63 + b" " + b"r" * 64 + b" s", b"0 " * 500]
    owner, bucket, n_words = resampling.features(texts)
    for i, text in enumerate(texts):
        words = text.split()
        runs = [b" ".join(words[j : j + k]) for k in (1, 2, 3) for j in range(len(words) - k + 1)]
        assert Counter(bucket[owner == i].tolist()) == Counter(zlib.crc32(r) % 10_000 for r in runs)
        assert n_words[i] == len(words)


# --- hard negatives -----------------------------------------------------------------------------


def brute_negatives(rows, every):
    def able(r):
        return r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    held = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in filter(able, rows)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (anchor, a, label) in enumerate(held):
        if anchor is None or anchor % every:
            continue
        score = [(sum(x * y for x, y in zip(a, b, strict=False)), i, lb, m) for m, (i, b, lb) in enumerate(held) if m != n]
        for p, positive, _, _ in sorted((x for x in score if x[2] == label), key=order)[:5]:
            found = sorted((x for x in score if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=order)[:5]
            out += [(anchor, positive, k + 1, x[1], p, x[0]) for k, x in enumerate(found)]
    return sorted(out, key=repr)


def vectors(seed, n=400, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (1 + 3 * (i % 9 == 0)) for _ in range(dims)], rng.randint(0, 3)) for i in range(n)]
    rows += [(n + i, rows[40][1], i % 3) for i in range(30)]  # ties
    return rows


ODD_VECTORS = [
    (1000, None, 1), (1010, [1.0, None], 1), (1020, [float("nan")], 1), (1030, [float("inf"), 1.0], 1), (1040, [1.0] * 6, None), (None, [1.0] * 6, 1), (1050, [], 1), (1060, [2.0, 2.0], 1),
    (40, [0.5] * 6, 1), (40, [0.5] * 6, 1), (1070, [0.0] * 6, 2), (1080, [1e6] * 6, 2), (1090, [3e5] * 6, 1), (1100, [-1e6] * 6, 1), (1110, [9e5] * 6, 0),
]


@pytest.mark.parametrize("rows", [vectors(1), vectors(2, dims=1), vectors(3, 60) + ODD_VECTORS])
@pytest.mark.parametrize("sizes", [(8192, 1024, 4096), (50, 16, 3)])
def test_hard_negatives(spark, monkeypatch, rows, sizes):
    for name, value in zip(("BUCKET_ROWS", "BLOCK_ROWS", "LOT_ANCHORS"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).repartition(3)
    got = negatives.hard_negatives(df, every=10).collect()
    assert sorted(map(tuple, got), key=repr) == brute_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [1e300, -1.0], 1), (2, [1e20, 5.0], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(huge).count() >= 0


def test_short_buckets_are_pruned(spark, monkeypatch):
    """Blocks whose longest row can't reach the running fifth score are not compared."""
    seen = []
    best = negatives._Best(1, 2)
    rows = np.array([[9.0, 0], [8, 0], [7, 0]])
    block = negatives.Block(np.arange(3), np.zeros(3, bool), np.zeros(3, np.int64), rows, np.linalg.norm(rows, axis=1), np.arange(3))
    best.add(np.zeros(3, np.int64), np.array([9, 8, 7]), block, np.arange(3))
    seen = best.limit.tolist()
    assert seen == [8] and negatives._reach(np.array([1.0]), 6.0)[0] < 8 <= negatives._reach(np.array([1.0]), 8.0)[0]
