"""Whitening and exact top-k search against brute force in numpy and plain integers, and on odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chaptermill.llm import topk, whitening
from chaptermill.llm.vectors import with_integers

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
UNUSABLE = [None, [], [1.0, None, 2.0], [NAN, 0.0, 1.0], [INF, 0.0, 1.0], [0.0, -INF, 1.0], [3e38, 0.0, 1.0]]


def floats(rows):
    return [[float(x) for x in r] for r in np.asarray(rows, np.float32)]


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").cache()


def whitened_plainly(vectors):
    """Exact integers first, then eigenvectors of the covariance."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, centred, values[::-1], directions.T[::-1]


def whitened_rows(vectors):
    found = {}
    for r in whitening.components_of(vectors).collect():
        found.setdefault(r.vec_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.component) for k, v in found.items()}


def assert_whitened(vectors, found, components):
    """Against plain numpy: equal up to the sign of each component."""
    n, deviations, centred, values, directions = whitened_plainly([v for _, v in vectors])
    assert sorted(found) == sorted(i for i, _ in vectors)
    want = centred @ directions[:components].T / np.sqrt(values[:components])
    got = np.array([[r.whitened for r in found[i]] for i, _ in vectors])
    sign = np.sign((want * got).sum(axis=0))
    assert np.allclose(want * sign, got, atol=1e-7)
    for (i, _), deviation in zip(vectors, deviations, strict=True):
        assert [r.component for r in found[i]] == list(range(1, components + 1))
        assert all(r.n == n and r.deviation == deviation for r in found[i])
        assert np.allclose([r.explained for r in found[i]], values[:components] / values.sum(), rtol=1e-9)
        assert found[i][0].identity_error < 1e-8
    assert np.allclose(np.cov(got.T, bias=True), np.eye(components), atol=1e-8)


def test_whitening_against_eigenvectors(embeddings):
    vectors = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    assert_whitened(vectors, whitened_rows(embeddings.repartition(7)), 32)


def test_whitening_odd(spark):
    rng = np.random.default_rng(5)
    good = floats(rng.normal(size=(40, 3)) * [3, 1, 0.2])
    rows = [(i, v, 0) for i, v in enumerate(good)]
    odd = [(100 + i, v, 0) for i, v in enumerate([*UNUSABLE, [1.0, 2.0], [0.5]])]
    frame = spark.createDataFrame([*rows, *odd], SCHEMA).withColumns({"whitened": F.lit("taken"), "x": F.lit(1), "n": F.lit(2)})
    assert_whitened([(i, v) for i, v, _ in rows], whitened_rows(frame), 3)
    repeated = whitening.components_of(spark.createDataFrame([*rows, *rows, (None, good[0], 0)], SCHEMA)).collect()
    assert len(repeated) == 81 * 3 and {r.n for r in repeated} == {81}


@pytest.mark.parametrize("vectors, components", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [3.0, 2.0]], 1), ([[i, 2 * i, 7] for i in range(9)], 1)])
def test_whitening_without_variance(spark, vectors, components):
    rows = whitening.components_of(spark.createDataFrame([(i, floats([v])[0], 0) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert len(rows) == components * len(vectors)
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in rows)


def test_whitening_exact_sums_of_large_components(spark):
    rows = [(i, [float(i * 2**40), -1.5 * i, 2.0**50], 0) for i in range(7)]
    integers = with_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "embedding", "x", 64, 1_000_000)
    n, sums = whitening.exact_sums(integers, "x")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    assert n == 7 and sums == [sum(c) for c in zip(*x, strict=True)]
    model = whitening.fit(integers, "x")
    got = {r.vec_id: r.deviation for r in whitening.whiten(integers, "x", model).collect()}
    for (i, _, _), v in zip(rows, x, strict=True):
        exact = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert got[i] == (exact if exact < 1 << 63 else None)


def best_plainly(rows, k, is_query=lambda i: i % 100 == 0):
    """(query_id, rank, vec_id, score) of every pair, by Python's integers."""
    bad = lambda v: v is None or any(c is None or not math.isfinite(c) or abs(c) * 1024 >= 2**62 for c in v)
    used = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if not bad(v)]
    found = []
    for i, q in used:
        if i is not None and is_query(i):
            score = lambda c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=False))))  # noqa: B023, E731
            scored = sorted((-score(c), j is None, j or 0) for j, c in used if j != i)
            found += [(i, rank, None if no_id else j, -s) for rank, (s, no_id, j) in enumerate(scored[:k], 1)]
    return sorted(found, key=str)


def nearest(spark, rows):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    return sorted([tuple(r) for r in topk.nearest(frame.repartition(3)).select("query_id", "rank", "vec_id", "score").collect()], key=str)


@pytest.mark.parametrize("tile", [(128, 2048), (2, 7)])
def test_topk_with_ties_and_zeros(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    rng = np.random.default_rng(11)
    some = rng.integers(-2, 3, (300, 6)) * (rng.random((300, 6)) < 0.4)
    rows = [(i if i < 250 else i % 7 * 100, floats([v])[0]) for i, v in enumerate(some)]
    assert nearest(spark, rows) == best_plainly(rows, 10)


def test_topk_odd(spark):
    rows = [(0, [1.0, 2.0, 0.5]), (100, []), (200, [2.5]), (300, [0.0, 0.0, 0.0, 4.0]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5])]
    rows += [(400 + 100 * i, v) for i, v in enumerate(UNUSABLE[:1] + UNUSABLE[2:])]
    assert nearest(spark, rows) == best_plainly(rows, 10)
    assert nearest(spark, []) == [] and nearest(spark, [(1, [1.0])]) == [] and nearest(spark, [(100, [1.0])]) == []


@pytest.mark.parametrize("size", [1e3, 1e9, 1e15])
def test_topk_scores_of_any_size(spark, size):
    rng = np.random.default_rng(3)
    rows = [(100 * i, (rng.normal(size=5) * size).tolist()) for i in range(30)]
    assert nearest(spark, rows) == best_plainly(rows, 10)


def test_topk_queries_in_blocks(spark, embeddings, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 64 * 8 * 9)
    integers = with_integers(embeddings.select("vec_id", "embedding"), "embedding", "x", topk.SCALE)
    got = topk.search(integers, F.col("vec_id") % 20 == 0, 3).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted([tuple(r) for r in got], key=str) == best_plainly([(r.vec_id, r.embedding) for r in embeddings.collect()], 3, lambda i: i % 20 == 0)
