"""Runs of words, nearest vectors and whitening against brute force, on rows with every odd case."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.llm import forest, runs, whitening

DOCS = "doc_id long, text string, start long, length string, period int"
VECTORS = "vec_id long, embedding array<double>, label int, rep string, tree int, e string, x long"


def runs_of(words):
    """(start, period, length) by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


def repetitive(rng):
    k = rng.choice([1, 2, 3, 40])
    words = [rng.randrange(k) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 3)):
        part = [rng.randrange(k) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(words))
        words[at:at] = (part * 9)[: rng.randint(1, 9 * len(part))]
    return words


def test_cover_reaches_every_difference():
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))
    assert runs.SHIFT.max() < runs.MODULUS


@pytest.mark.parametrize("places", [runs.PLACES, 7])
def test_runs_equal_brute_force(monkeypatch, places):
    monkeypatch.setattr(runs, "PLACES", places)
    rng = random.Random(places)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 5))]
        texts += texts[:2] + [list(range(60))] * 2  # texts with the same words
        got = [[] for _ in texts]
        for own, s, n, q in zip(*(c.tolist() for c in runs.find_runs([np.array(t, np.int64) for t in texts])), strict=True):
            got[own].append((s, q, n))
        assert got == [runs_of(t) for t in texts]


def test_extensions_equal_word_by_word_comparison():
    rng = random.Random(5)
    x = [rng.randrange(2) for _ in range(200)] + [0] * 150 + [0, 1] * 80
    i, j = (np.array([rng.randrange(len(x)) for _ in range(2000)]) for _ in "ab")
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        k = 0
        while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        return k

    assert runs.Extensions(np.array(x))(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{w}" for w in repetitive(rng)) + rng.choice(["", " ", "\n"])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (203, "la " * 3000), (204, "x y　z\x1c\x85 " * 12), (205, "a b\tc\nd " * 400), (None, "no " * 9), (None, None)]
    rows += [(206, " ".join(str(i % 37) for i in range(4000))), rows[3], rows[203 - 80]]
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DOCS).repartition(3)


def test_run_digests(docs):
    def want(doc, text):
        words = runs.plant(doc, (text or "").encode().split())
        found = runs_of(words)
        drop = {i for s, q, n in found for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, q, n in found), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        return (doc, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    got = Counter(map(tuple, runs.run_digests(docs).collect()))
    assert got == Counter(want(r.doc_id, r.text) for r in docs.collect())
    assert sum(k[1] > 1 for k in got) > 10
    assert runs.run_digests(docs.where("false")).count() == 0


def test_planted_words_follow_the_rule():
    import zlib

    for doc in range(400):
        words = [str(i).encode() for i in range(doc % 61)]
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert runs.plant(doc, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        else:
            assert runs.plant(doc, words) == words


def test_periodic_runs_keep_the_first_period(spark):
    rows = [(1, "x " + "a b c " * 4 + "y"), (2, "a b c " * 3), (3, None)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 12, 3)] and got[1].collapsed == "x a b c y"
    assert not got[2].runs and got[2].collapsed == "a b c a b c a b c"
    assert (got[3].n_words, got[3].runs, got[3].collapsed) == (0, [], "")


def sound(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    copy = rows[50][1]
    rows += [(2000 + i, copy) for i in range(300)] + [(2400 + i, (np.array(copy) + 0.001 * rng.standard_normal(16)).tolist()) for i in range(300)]
    rows += [(3000, None), (3050, []), (3100, [0.0] * 16), (3150, [float("nan")] * 16), (3200, [None] + [1.0] * 15), (3250, [math.inf] * 16), (None, copy)]
    rows += [(3300, [1.0, 2.0]), (3350, [2.0, 1.0]), (3351, [1.0, 1.0]), (3400, [1e300] * 16), (-50, [1e-300] * 16), rows[7], (7, rows[9][1])]
    return spark.createDataFrame([(*r, 1, "r", 2, "e", 3) for r in rows], VECTORS).repartition(5)


def test_nearest_vectors(vectors):
    rows = sorted({(r.vec_id, tuple(r.embedding)) for r in vectors.collect() if r.vec_id is not None and sound(r.embedding)})
    units = [(v, np.array(e) / np.abs(e).max()) for v, e in rows]
    units = [(v, x / np.linalg.norm(x)) for v, x in units]
    got = {}
    for r in forest.nearest_of_fiftieths(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = all_ = 0
    for v, x in units:
        if v % 50:
            continue
        scores = sorted((-round(float(x @ y), 12), w) for w, y in units if len(y) == len(x) and not (w == v and y is x))[:5]
        mine = sorted(got.pop(v))
        assert [k for k, _, _ in mine] == list(range(1, len(scores) + 1))
        assert [m[1:] for m in mine] == [m[1:] for m in sorted(mine, key=lambda m: (-round(m[2], 12), m[1]))]
        of = {}
        for w, y in units:
            of.setdefault(w, []).append(y)
        assert all(any(len(y) == len(x) and abs(s - x @ y) < 1e-12 for y in of[w]) for _, w, s in mine)
        all_ += len(scores)
        hit += sum(s >= -scores[-1][0] - 1e-11 for _, _, s in mine)
    assert not got and hit / all_ >= 0.95


def test_nearest_where_few_exist(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in forest.nearest_of_fiftieths(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 51), (0, 2, 50), (50, 1, 51), (50, 2, 0)]
    assert forest.nearest_of_fiftieths(few.where("vec_id = 0")).count() == 0
    assert forest.nearest_of_fiftieths(few.where("false")).count() == 0


def test_beginnings_decide_what_is_compared(spark):
    """Clustered vectors are found below long beginnings: few candidates are enough, and levels differ by density."""
    rng = np.random.default_rng(9)
    x = np.concatenate([c + 0.02 * rng.standard_normal((200, 32)) for c in rng.standard_normal((60, 32))])
    codes = forest.hash_strings(x / np.linalg.norm(x, axis=1, keepdims=True))
    own = forest.Forest(codes, len(x))
    none = np.zeros(len(x), bool)
    level = own.level(codes, none, 800.0)
    below = np.array([sum((forest.shared(codes[:, t], codes[k, t]) >= level[k]).sum() for t in range(forest.TREES)) for k in range(0, len(x), 400)])
    assert (below >= 800).all() and below.max() < 0.2 * forest.TREES * len(x) and len(set(level.tolist())) > 3
    for k in range(0, len(x), 400):  # one bit more would hold too few
        deeper = sum((forest.shared(codes[:, t], codes[k, t]) > level[k]).sum() for t in range(forest.TREES))
        assert deeper < 800
    blocks = own.blocks_of(codes, np.zeros(len(x), np.int64))
    assert np.bincount(blocks[:, 0]).max() < 4 * forest.BLOCK


def test_cross_products_are_exact():
    rng = np.random.default_rng(0)
    for x in (rng.integers(-300, 300, (1000, 5)), rng.integers(-(2**63), 2**63 - 1, (70, 3)), np.full((3, 2), 7), np.zeros((1, 2), np.int64)):
        sums, products = whitening.cross_products(x.astype(np.int64))
        o = x.astype(object)
        assert sums == o.sum(0).tolist()
        want = o.T @ o
        assert all(products[i][j] == want[i][j] for i in range(x.shape[1]) for j in range(i, x.shape[1]))


@pytest.mark.parametrize("rows", [whitening.ROWS, 100])
def test_whitened(vectors, monkeypatch, rows):
    monkeypatch.setattr(whitening, "ROWS", rows)
    given = vectors.where("size(embedding) = 16").where(~F.exists("embedding", lambda c: F.abs(c) > 1e6))
    good = [(r.vec_id, [math.floor(256 * c) for c in r.embedding]) for r in given.collect() if all(c is not None and math.isfinite(c) for c in r.embedding)]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, total = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whitened_vectors(given).toPandas()
    assert len(got) == 4 * len(good) and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    want = {(v, k + 1, int(((n * np.array(x) - total) ** 2).sum()), round(abs((np.array(x) - total / n) @ axes[:, k]) / values[k] ** 0.5, 6)) for v, x in good for k in range(4)}
    mine = {(None if v != v else int(v), int(k), int(d), round(abs(w), 6)) for v, k, d, w in zip(got.vec_id, got.component, got.deviation, got.whitened)}
    assert mine == want
    for k in range(4):
        assert np.allclose(got.explained[got.component == k + 1], values[k] / values.sum(), rtol=1e-9)
        signs = {np.sign(w * ((np.array(x) - total / n) @ axes[:, k])) for v, x in good if v != 7 for w in got.whitened[(got.vec_id == v) & (got.component == k + 1)] if abs(w) > 1e-6}
        assert len(signs) == 1  # one sign for all rows


def test_whitened_where_nothing_varies(spark):
    form = "vec_id long, embedding array<double>"
    one = whitening.whitened_vectors(spark.createDataFrame([(1, [0.5, -0.001]), (1, [0.5, -0.001]), (2, [None, 1.0]), (3, [])], form)).collect()
    assert [tuple(r) for r in one] == [(1, k, 1, 0, None, 0.0, None) for k in (1, 2, 1, 2)]
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], form)).collect()
    assert {r.deviation for r in far} == {None} or all(r.deviation > 2**63 for r in far)
    assert whitening.whitened_vectors(spark.createDataFrame([], form)).count() == 0
