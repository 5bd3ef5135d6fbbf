"""Whitening against Python's fractions, and its cases."""
import math
import os
from fractions import Fraction

import numpy as np
import pytest

from foliospark.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n long, whitened string, id string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def exact(vectors):
    """n, sums, deviations and the covariance of integer vectors, in fractions."""
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = [[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)]  # Python rounds a quotient of integers once
    return x, n, s, dev, np.array(cov)


def checked(rows, vectors, components=32):
    x, n, s, dev, cov = exact(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(values))
    want = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x]) @ axes[:, :k] / np.sqrt(values[:k])
    got = np.full((n, k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, dev[r.vec_id])
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9)
        assert r.identity_error <= 1e-4
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-7) and not np.isnan(got).any()


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(np.float32(c)) for c in rng.normal(size=5) * (1, 2, 3, 4, 900)] for _ in range(40)]
    checked(whitening.whiten(frame(spark, vectors).repartition(3)).collect(), vectors)
    assert {r.component for r in whitening.whiten(frame(spark, vectors), components=2).collect()} == {1, 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    at = {r.vec_id: k for k, r in enumerate(rows)}
    got = [r.asDict() | {"vec_id": at[r.vec_id]} for r in whitening.op13(spark, SF).collect()]
    checked([type(spark.range(1).first())(**r) for r in got], [r.embedding for r in rows])


def test_limbs_and_words():
    rng = np.random.default_rng(1)
    for y in (rng.integers(-(1 << 40), 1 << 40, (70, 3)), rng.integers(-(1 << 61), 1 << 61, (70, 3)), np.array([[-(1 << 100), 5], [1 << 99, -(1 << 98)]], object), np.zeros((2, 2), np.int64)):
        parts = whitening.limbs(y)
        assert all(abs(p).max() <= 1 << (whitening.LIMB - 1) for p in parts)
        assert (sum((p.astype(np.int64).astype(object) << (whitening.LIMB * k) for k, p in enumerate(parts)), np.zeros(y.shape, object)) == y).all()
        o = y.astype(object)
        assert (whitening.gram(y) == o.T @ o).all()
    for v in (0, 5, -5, 1 << 200, -(1 << 130) + 7):
        words = whitening.to_words(v)
        assert sum(w << (60 * k) for k, w in enumerate(words)) == v and all(abs(w) < 1 << 60 for w in words)


def test_blocks(monkeypatch):
    y = np.random.default_rng(2).integers(-(1 << 50), 1 << 50, (50, 4))
    monkeypatch.setattr(whitening, "BLOCK", 7)
    assert (whitening.gram(y) == y.astype(object).T @ y.astype(object)).all()


def test_cases(spark):
    """Nulls, bad entries, repeated rows, short vectors, huge entries, ids past 2 ** 53 beside a null."""
    good = [[1.0, 2.0, -3.0], [0.5, -2.0, 1.0], [0.5, -2.0, 1.0], [4.0, 0.0, 0.25], [-1.0, 3.0], []]
    bad = [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0]]
    big = (1 << 60) + 1
    ids = [big, None, 7, 7, 8, 9] + [100, 101, 102, 103]
    got = whitening.whiten(frame(spark, good + bad, ids)).collect()
    assert {r.vec_id for r in got} == {big, None, 7, 8, 9} and len(got) == 6 * 3
    _, n, _, dev, _ = exact([v + [0.0] * (3 - len(v)) for v in good])
    assert {(r.vec_id, r.deviation) for r in got} == set(zip(ids, dev)) and {r.n for r in got} == {n}
    huge = whitening.whiten(frame(spark, [[3e38, 1.0], [-3e38, 2.0], [5.0, 7.0]])).collect()
    assert len(huge) in (3, 6) and all(r.deviation is None for r in huge if r.vec_id < 2)
    text = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0]), ("c", [0.0, 0.5])], "key string, v array<double>")
    assert {r.key for r in whitening.whiten(text, "key", "v").collect()} == {"a", "b", "c"}


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(frame(spark, [[], []])).count() == 0
    flat = whitening.whiten(frame(spark, [[1.0, 2.0], [2.0, 4.0], [5.0, 10.0]])).collect()  # one direction alone varies
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)
