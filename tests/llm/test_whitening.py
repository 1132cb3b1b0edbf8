"""Whitening against numpy's eigenvectors, on edge cases and on the small table."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tapeloom.llm import queries, whitening


def brute(rows, most=16):
    """Expected rows per (id, x): n, deviation, and whitened up to sign."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in good})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    exact = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in listed])
    cov = exact.T @ exact / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    order = [k for k in order if values[k] > len(sums) * whitening.EPS * values.max()]
    out = []
    for i, x in good:
        y = [n * c - s for c, s in zip(x, sums)]
        w = np.array([float(Fraction(v, n)) for v in y]) @ vectors[:, order] / np.sqrt(values[order])
        out += [(i, k + 1, n, sum(v * v for v in y), float(w[k]), float(values[order[k]] / np.trace(cov))) for k in range(len(order))]
    return out


def compare(df, rows):
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    want = brute(rows)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    signs = {}
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] <= 1e-9
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(g[1], math.copysign(1, g[4] * w[4])) == math.copysign(1, g[4] * w[4])
        assert math.isclose(abs(g[4]), abs(w[4]), rel_tol=1e-6, abs_tol=1e-7)


def test_whitening_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    compare(df, [(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert queries.op12_embedding_whitening(spark, sf_dir).count() == 16 * df.count()


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    base = [(k, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for k in range(40)]
    rows = base + [(100 + k, base[0][1]) for k in range(30)] + [(3, base[5][1]), (None, base[6][1]), (None, base[6][1]), (500, None),
                                                              (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("-inf")] + [0.0] * 4)]
    short = [(600, [1.0, 2.0]), (601, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + short], "vec_id long, embedding array<double>, id string")
    compare(df, rows)
    one = whitening.fit(df.where("vec_id >= 100 AND vec_id < 130"))
    assert one.n == 1 and whitening.whiten(df, one).count() == 0
    none = whitening.fit(df.limit(0))
    assert none.n == 0 and whitening.whiten(df, none).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 7.0, float(2 * k)]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat, whitening.fit(flat)).collect()} == {1}


def test_exact_values():
    x = np.array([[2**40, 0], [0, 2**40], [1, 1]], np.int64)
    model = whitening.Whitening(3, [int(v) for v in x.sum(axis=0)], np.zeros((2, 0)), np.zeros(0), np.zeros(0), 64, 0)
    assert [int(v) for v in model.deviations(x)] == [sum((3 * c - s) ** 2 for c, s in zip(r, model.sums)) for r in x.tolist()]


@pytest.mark.parametrize("spectrum", [[3, 3, 3, 1, 1], [0] * 6, [1] * 9 + [0] * 9, [2.0], list(10.0 ** -np.arange(30)), list(np.random.default_rng(2).random(70))])
def test_divide_and_conquer(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(d, d)))
    a = (q * np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigen(a)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
