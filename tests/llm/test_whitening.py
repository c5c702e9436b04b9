import math

import numpy as np
import pytest

from periodix.llm import whitening as W


def reference(rows):
    """Fit list, covariance eigenpairs and deviations with numpy and Python integers."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, s = len(fit), [sum(c) for c in fit.T]
    centred = (fit.astype(float) - np.array([float(v) for v in s]) / n)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, s, values[::-1], vectors[:, ::-1]


def got_rows(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").selectExpr(
        "*", "1 AS n", "'x' AS x", "2 AS component").repartition(3)
    return W.whiten(df, **more).collect()


def test_against_eigh(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 24)) @ np.diag(np.linspace(3, 0.2, 24)) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(None, rows[1][1]), (999, rows[2][1])]
    odd = [(2000, None), (2001, [1.0] * 23 + [None]), (2002, [math.nan] + [0.0] * 23), (2003, [math.inf] * 24), (2004, []),
           (2005, [1.0, 2.0])]
    got = got_rows(spark, rows + odd)
    kept, n, s, values, vectors = reference(rows)
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n} == {401 - 1}
    assert got[0]["identity_error"] < 1e-10 and len({r["identity_error"] for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), r)
    white = np.array([[by[i, c]["whitened"] for c in range(1, 17)] for i, _ in kept])
    x = np.array([v for _, v in kept], float) - np.array([float(v) for v in s]) / n
    want = x @ vectors[:, :16] / np.sqrt(values[:16])
    sign = np.sign((white * want).sum(axis=0))
    assert np.abs(white * sign - want).max() < 1e-9
    for i, v in kept[:50]:
        assert by[i, 1]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(v, s))
    for c in range(16):
        assert by[0, c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-10)


def test_constant_and_dependent_dimensions(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (60, 3)) / 64
    v = np.column_stack([a, a[:, 0], np.full(60, 0.5), a[:, 1] + a[:, 2]])
    got = got_rows(spark, list(enumerate(v.tolist())))
    assert {r["component"] for r in got} == {1, 2, 3} and got[0]["identity_error"] < 1e-10


def test_edges(spark):
    assert got_rows(spark, []) == [] and got_rows(spark, [(1, None), (2, [])]) == []
    assert got_rows(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []  # one distinct vector
    two = got_rows(spark, [(1, [0.5, 0.25]), (2, [1.5, 0.25]), (2, [1.5, 0.25])])
    assert sorted((r["vec_id"], abs(round(r["whitened"], 9))) for r in two) == [(1, 1.0), (2, 1.0), (2, 1.0)]
    far = got_rows(spark, [(k, [1e38 if k % 2 else float(k), 0.0]) for k in range(20)])
    assert len(far) == 20 and all(r["deviation"] is None for r in far)


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "pairs", "split", "zeros", "one"])
def test_solver(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "one" else 40
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    sigma = {"random": rng.random(d) + 0.1, "graded": 10.0 ** -np.linspace(0, 12, d), "equal": np.ones(d),
             "pairs": np.repeat(np.linspace(1, 5, d // 2), 2) if d > 1 else np.ones(1),
             "split": np.linspace(1, 9, d), "zeros": np.r_[np.linspace(1, 9, d // 2), np.zeros(d - d // 2)],
             "one": np.array([3.0])}[kind]
    r = np.linalg.qr(np.diag(sigma) @ (np.eye(d) if kind == "split" else q.T), mode="r")
    values, vectors, total = W.eigen(r, d)
    want = np.sort(sigma)[::-1] ** 2
    assert total == pytest.approx(want.sum(), rel=1e-12)
    assert len(values) == (want > 0).sum()
    np.testing.assert_allclose(values, want[:len(values)], rtol=1e-10 if kind != "graded" else 1e-2)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    top = 8 if kind == "graded" else len(values)
    c = r.T @ r
    assert np.abs(c @ vectors[:, :top] - vectors[:, :top] * values[:top]).max() < 1e-11 * want[0]


def test_dqds_is_relatively_accurate():
    """A graded bidiagonal: small values to all digits (against exact products)."""
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([1e-2, 1e-5, 1e-8])
    values = W.dqds(a, b)
    assert np.prod(values) == pytest.approx(np.prod(a ** 2), rel=1e-13)
    assert values.sum() == pytest.approx((a ** 2).sum() + (b ** 2).sum(), rel=1e-14)


def test_triangles_are_folded(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 3)
    rng = np.random.default_rng(5)
    x = rng.integers(-90, 90, (500, 7))
    fit = spark.createDataFrame([(v.astype("<i8").tobytes(),) for v in x], "x BINARY").repartition(11)
    n, s = W.sums(fit, 7)
    assert (n, s) == (500, x.sum(axis=0).tolist())
    r = W.triangle(fit, 7, n, s)
    centred = x - x.mean(axis=0)
    np.testing.assert_allclose(r.T @ r, centred.T @ centred, rtol=1e-12, atol=1e-7)
