"""Importance resampling, the block matrix join and periodic runs against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firn.llm import matrix, resample, runs

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, row long, rank int, n_words long, _g long, vector string"
TEXTS = [None, "", "   ", "a", "A b a B a b a b a b a b a b c", "é ü ß 漢字 🙂 " * 9, "x " * 300_000, "1234 5678-1234", "lone\x1cword\xa0kept", "Repeat Me now " * 12]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, 0.5, 1, 2, 3, 4, "v") for i, t in enumerate(TEXTS)]
    rows += [(500, "one row twice " * 8, 0.5, 1, 2, 3, 4, "v")] * 2 + [(None, "no id " * 20, 0.5, 1, 2, 3, 4, "v")] * 2
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- resampling


def brute_states(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [crc32(" ".join(words[i : i + n]).encode()) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, max_n, buckets=10_000, percent=10, least=20):
    source, aim = Counter(), Counter()
    for _, text in rows:
        source.update(c % buckets for c in brute_states(text, max_n)[1])
    for text in target:
        aim.update(c % buckets for c in brute_states(text, max_n)[1])
    big_s, big_t = source.total(), aim.total()
    out = []
    for doc_id, text in rows:
        n, states = brute_states(text, max_n)
        weight = sum(math.floor(1000 * math.log((aim[c % buckets] + 1.0) * (big_t * 0 + big_s + buckets) / ((source[c % buckets] + 1.0) * (big_t + buckets)))) for c in states)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(states), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_resample_equals_brute_force(spark, max_n):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    aim = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = sorted((tuple(r) for r in resample.resample(docs, aim, max_n).collect()), key=repr)
    assert got == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in aim.collect()], max_n)


def test_resample_awkward(spark, awkward, empty):
    got = sorted((tuple(r) for r in resample.resample(awkward, awkward, 2, percent=50, least_words=2).collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got == brute_resample(rows, [t for _, t in rows], 2, percent=50, least=2)
    assert resample.resample(empty, awkward).count() == 0
    assert resample.resample(awkward, empty).count() == len(rows)


def test_head_changes_no_state():
    words = b"the cat the cat sat on the mat".split()
    full = resample.Vocabulary({b"the", b"cat"}, {b"the cat"})
    assert (full.states(words, 3) == resample.Vocabulary().states(words, 3)).all()
    assert dict(full.pairs).keys() == {(b"the", b"cat")} and dict(full.words).keys() == {b"the", b"cat"}


def test_head_holds_the_frequent(spark):
    docs = spark.createDataFrame([("a a b c " * 50 + "rare",), ("a d e",), (None,), ("z" * 100 + " a",)], "text string")
    found = resample.head(docs, 2, most=5)
    assert set(found.words) == {b"a", b"b", b"c"} and {b"a", b"b"} <= {w for p in found.pairs for w in p}


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(7, "w " * 30)] * 5, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in resample.resample(docs, docs, percent=100).collect())
    assert ranks == [1, 2, 3, 4, 5]


# --- block matrix join


def brute_nearest(rows, k):
    ok = [(n, i, v) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in ok:
        if i is None or i % 100:
            continue
        near = []
        for m, j, w in ok:
            if m != n and len(w) == len(v):
                total = 0.0
                for x, y in zip(v, w):
                    total += (x - y) * (x - y)
                near.append((math.sqrt(total), j is None, j or 0, m))
        out += [(i, r + 1, None if e[1] else e[2], e[0]) for r, e in enumerate(sorted(near)[:k])]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, row long, _query string"


def test_nearest_equals_brute_force_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(matrix, "BLOCK_ROWS", 64)
    monkeypatch.setattr(matrix, "TILE_ROWS", 8)
    draw = np.random.default_rng(3)
    rows = [(i * 20, [float(x) for x in np.round(draw.normal(size=7), 1)]) for i in range(400)]
    rows += [(1000, [1.0] * 7)] * 60 + [(1001 + i, [1.0] * 7) for i in range(90)] + [(None, [1.0] * 7)] * 3
    rows += [(5, None), (100, []), (100, [0.0] * 7), (100, [1.0, None]), (100, [float("nan")] * 7), (100, [float("inf")] * 7), (200, [1e-320] * 7), (300, [1e150] * 7)]
    rows += [(700, [1.0, 2.0]), (701, [1.0, 2.5]), (702, [-4.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2, "q") for i, v in rows], VECTORS)
    got = sorted((tuple(r) for r in matrix.nearest(table, F.col("vec_id") % 100 == 0).collect()), key=repr)
    assert got == brute_nearest(rows, 10)


def test_nearest_of_nothing(spark):
    table = spark.createDataFrame([], VECTORS)
    assert matrix.nearest(table, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0], 1, 2, "q")], VECTORS)
    assert matrix.nearest(alone, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("width", [3, 64, 1500])
def test_bounds_hold_and_prune(width):
    draw = np.random.default_rng(width)
    x, y = draw.normal(size=(40, width)), draw.normal(size=(900, width)) * draw.choice([0.01, 1, 30], size=(900, 1))
    least, most = matrix.bounds(matrix.Coded(x), matrix.Coded(y))
    exact = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()
    codes = matrix.Coded(x).products(matrix.Coded(y))
    assert (codes == matrix.Coded(x).codes.astype(np.int64) @ matrix.Coded(y).codes.astype(np.int64).T).all()
    seen = []
    as_table = lambda m: pa.table({"row": np.arange(len(m)) + id(m) % 7 * 10_000, "vec_id": np.arange(len(m)), "vector": pa.array(list(m), pa.list_(pa.float64()))})
    matrix.search_block(as_table(x), as_table(y), 5, 32, seen)
    assert sum(seen) < 40 * 900 / 4


# --- periodic runs


def brute_runs(words, least):
    found = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            start = k
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k - start + p >= max(least, 2 * p):
                found.setdefault((start, k + p), p)
            k += k == start
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words, 12)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


@pytest.mark.parametrize("least", [4, 12])
def test_runs_equal_brute_force(least):
    draw = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(draw.randrange(1, 7)):
            n, letters = draw.randrange(90), draw.choice([1, 2, 2, 3, 30])
            text = [draw.randrange(letters) for _ in range(n)]
            if n > 4 and draw.random() < 0.5:
                a, p = draw.randrange(n), draw.randrange(1, n // 2 + 1)
                text = text[:a] + [text[a + (i - a) % p] for i in range(a, n)]
            texts.append(text)
        found = [[] for _ in texts]
        for owner, start, end, period in zip(*runs.runs_of([np.array(t, np.int64) for t in texts], least)):
            found[owner].append((start, end - start, period))
        assert found == [brute_runs(t, least) for t in texts]


def test_extensions_equal_brute_force():
    draw = np.random.default_rng(9)
    for letters in (1, 2, 5):
        body = draw.integers(0, letters, 300)
        row = np.concatenate(([0], body + 2, [1]))
        forward, backward = runs.Reader.both(runs.Grammar(row, 2))
        i, j = draw.integers(1, 300, 500), draw.integers(1, 300, 500)
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(400) if row[a + k] != row[b + k] or row[a + k] < 2) for a, b in zip(i, j)]
        before = [next(k for k in range(400) if row[a - 1 - k] != row[b - 1 - k] or row[a - 1 - k] < 2) for a, b in zip(i, j)]
        assert forward.extend(i, j).tolist() == want
        assert backward.extend(len(row) - i, len(row) - j).tolist() == before


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.length("text") < 6000)
    found = runs.digest(runs.periodic_runs(docs.select("doc_id", runs.looped(F.col("doc_id"), F.col("text")).alias("text"))))
    want = sorted(brute_digest(r["doc_id"], r["text"]) for r in docs.collect())
    assert sum(w[1] for w in want) > 10
    assert sorted(tuple(r) for r in found.collect()) == want


def test_runs_awkward(spark, awkward, empty):
    found = runs.digest(runs.periodic_runs(awkward)).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in found}
    assert len(found) == awkward.count() and runs.periodic_runs(empty).count() == 0
    for r in awkward.collect():
        # The loop of ids is left out here, so a string stands for the id.
        if r["doc_id"] != 6:
            assert got[r["doc_id"]] == brute_digest(None, r["text"])[1:]
    assert got[6][:5] == (1, 0, 300_000, 1, 300_000_000)
    edited = awkward.select(runs.looped(F.col("doc_id"), F.col("text")).alias("text"), "doc_id").filter("doc_id is null or text is null")
    assert {r["text"] for r in edited.collect()} == {None, "no id " * 20}
