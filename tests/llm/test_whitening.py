"""Whitening against the eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from quantloom.llm import whitening
from quantloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, VEC_ID string"


def expected(rows, wanted=4):
    """(vec_id, integers) of usable rows, n, sums, components and values."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    good = [(i, [math.floor(256.0 * float(np.float32(c))) for c in v]) for i, v in good if len(v) == size]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return good, len(fit), [int(s) for s in fit.sum(axis=0)], vectors[:, ::-1][:, :wanted], values[::-1]


def compare(rows, found, close=1e-8):
    good, n, sums, vectors, values = expected(rows)
    k = vectors.shape[1]
    assert len(found) == len(good) * k
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    whitened = []
    for i, x in good:
        key = (i, sum((n * c - s) ** 2 for c, s in zip(x, sums)))
        assert sorted(by[key]) == list(range(1, k + 1))
        whitened.append([by[key][c + 1][0].whitened for c in range(k)])
        for c in range(k):
            r = by[key][c + 1][0]
            assert r.n == n and r.identity_error <= 1e-4
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    whitened = np.array(whitened)
    direct = (np.array([x for _, x in good], float) - np.array(sums) / n) @ vectors / np.sqrt(values[:k])
    for c in range(k):
        sign = np.sign(whitened[:, c] @ direct[:, c])
        assert np.abs(whitened[:, c] * sign - direct[:, c]).max() < close


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(60, 60)) * np.linspace(1, 0.02, 60)
    rows = [(k, [float(c) for c in rng.normal(size=60) @ basis]) for k in range(300)]
    rows += [(900, rows[0][1])] * 200 + [(None, rows[1][1]), (None, rows[1][1]), (901, None), (902, []), (903, [None] * 60), (904, [float("nan")] * 60), (905, [float("inf")] + [0.0] * 59), (906, [1.0, 2.0]), (907, [0.0] * 60)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    data = whitening.vectors(table)
    fit = whitening.fit(data)
    assert fit.residual <= whitening.CERTIFIED and fit.passes > 3
    compare(rows, whitening.whiten(data, fit).collect())


def test_close_values_and_small_ranks(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(600, 64)) * np.r_[np.full(8, 1.02), np.ones(56)]
    few = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 30))
    exact = np.array([[a, b, 0, 0, 0] for a in (0, 1, 2) for b in (0, 1)], float)
    for points, components in ((flat, 4), (exact, 2)):
        rows = [(k, [float(c) for c in v]) for k, v in enumerate(points)]
        data = whitening.vectors(spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA))
        fit = whitening.fit(data)
        assert len(fit.values) == components and fit.identity_error < 1e-8
        if components == 4:
            compare(rows, whitening.whiten(data, fit).collect(), 1e-6)
    data = whitening.vectors(spark.createDataFrame([(k, [float(c) for c in v], "") for k, v in enumerate(few)], SCHEMA))
    assert len(whitening.fit(data).values) == 4  # rounding to integers fills all directions


def test_without_variance_and_beyond_the_range(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        data = whitening.vectors(spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA))
        assert whitening.whiten(data, whitening.fit(data)).collect() == []
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 5.0]), (3, [0.0, 0.0])]
    data = whitening.vectors(spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA))
    out = whitening.whiten(data, whitening.fit(data)).collect()
    assert {r.deviation is None for r in out if r.vec_id != 3} == {True} and all(math.isfinite(r.whitened) for r in out)


def test_filter_damps_the_unwanted():
    values = np.r_[np.linspace(20, 12, 4), np.linspace(10, 5, 60)]
    times = lambda q: values[:, None] * q
    out = whitening.filtered(times, np.eye(64), times(np.eye(64)), 12, 5.0, 10.0, 20.0)
    weight = np.abs(np.diag(out))
    assert weight[0] == pytest.approx(1) and weight[4:].max() < 1e-5 * weight[0] and weight[3] > 100 * weight[4:].max()
    found, vectors, residual = whitening.leading(times, 64, 4)
    assert np.allclose(found, values[:4]) and residual < 1e-13 and np.allclose(np.abs(np.diag(vectors[:4])), 1)


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(given, QUERIES["op11_embedding_whitening"](spark, folder).collect())
