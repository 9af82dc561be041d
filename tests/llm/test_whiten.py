"""Whitening: exact parts against plain definitions, results against LAPACK and closed forms."""

import math
import random

import numpy as np
import pytest

from riskrules.llm import whiten
from riskrules.llm.queries import op11_whitening
from riskrules.llm.shared import read


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    read(spark, "/root/testdata/sf0.001", "benchmark")


def by_minors(m):
    """det(xI - m), lowest power first, by Faddeev and LeVerrier in integers."""
    d = len(m)
    coef, a = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        a = m.dot(a) + coef[-1] * np.eye(d, dtype=int).astype(object)
        coef.append(-int(np.trace(m.dot(a))) // k)
    return coef[::-1]


def semidefinite(rng, d, rank, size=9):
    f = np.array([[rng.randrange(-size, size + 1) for _ in range(rank)] for _ in range(d)], object)
    return f.dot(f.T)


@pytest.mark.parametrize("d,rank,size", [(1, 1, 9), (2, 1, 5), (5, 5, 10**9), (6, 3, 4), (9, 9, 2), (12, 12, 10**4)])
def test_polynomial_is_exact(spark, d, rank, size):
    m = semidefinite(random.Random(d), d, rank, size)
    assert whiten.characteristic_polynomial(spark, m) == by_minors(m)


def test_hessenberg_with_missing_pivots():
    p = (1 << 31) - 1
    m = np.zeros((6, 6), np.int64)
    m[0, 5] = m[5, 0] = 3
    m[2, 4] = m[4, 2] = 7
    m[1, 1] = 5
    want = [c % p for c in by_minors(m.astype(object))]
    assert whiten.polynomial_mod(m, p).tolist() == want


def test_counts_and_roots_of_known_polynomials():
    for roots in ([3, 3, 3, 1, 0, 0], [10**12, 10**12 + 1, 5], [1, 2, 3, 4, 5, 6, 7], [1 << 40] * 4, [0, 0]):
        poly = [1]
        for r in roots:
            poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
        for at in (0, 1, 2, 5, 10**12):
            assert whiten.roots_above(poly, at, 0) == sum(r > at for r in roots)
        got = whiten.greatest_roots(poly, sum(roots), 16)
        flat = [r.decimal() for r in got for _ in range(r.times)]
        want = sorted((r for r in roots if r), reverse=True)
        assert len(flat) == len(want) and all(abs(a - b) <= b * 2.0**-150 for a, b in zip(map(float, flat), want))


def test_close_roots_are_told_apart(spark):
    """Two roots that agree to 1e-17 have the components of exact arithmetic."""
    m = np.array([[10**18, 3, 0], [3, 10**18, 0], [0, 0, 5]], object)
    roots = whiten.greatest_roots(whiten.characteristic_polynomial(spark, m), int(np.trace(m)), 3)
    assert [r.times for r in roots] == [1, 1, 1]
    v = whiten.components_of(spark, m, roots)
    half = math.sqrt(0.5)
    assert np.allclose(np.abs(v), [[half, half, 0], [half, half, 0], [0, 0, 1]], rtol=0, atol=1e-15)
    assert v[0][0] * v[0][1] > 0 > v[1][0] * v[1][1]


def expected(rows):
    """Results by LAPACK over the distinct integer vectors."""
    held = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in held)
    held = [(i, v) for i, v in held if len(v) == dim]
    u = np.unique(np.array([v for _, v in held]), axis=0)
    c = np.cov(u.T, bias=True).reshape(dim, dim)
    w, vec = np.linalg.eigh(c)
    return held, u, w[::-1], vec[:, ::-1], np.trace(c)


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(20)]) for i in range(300)]
    rows += [(500, rows[0][1]), (500, rows[1][1]), (None, rows[2][1]), (501, None), (502, []), (503, [1.0, None] * 10), (504, [float("nan")] * 20)]
    rows += [(505, [float("inf")] * 20), (506, [1.0] * 7), (507, [1e300] * 20)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n string").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [(r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = op11_whitening(spark, str(tmp_path)).collect()
    held, u, w, vec, trace = expected(stored)
    assert len(got) == 16 * len(held) == 16 * 303
    n, s = len(u), (u + 1_000_000).sum(axis=0)
    far = {}
    for i, v in held:
        far.setdefault(i, set()).add(int(sum((n * int(x + 1_000_000) - int(t)) ** 2 for x, t in zip(v, s))))
    for r in got:
        assert r["n"] == n == 300 and r["deviation"] in far[r["vec_id"]]
        assert abs(r["explained"] / (w[r["component"] - 1] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-12
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    for i, v in held[:250]:
        mine = [abs(r["whitened"]) for r in sorted(by_id[i], key=lambda r: r["component"])]
        assert np.allclose(mine, np.abs((v - u.mean(axis=0)) @ vec / np.sqrt(np.abs(w)))[:16], atol=1e-8)
    # one sign and one value for equal vectors
    a, b = ([r["whitened"] for r in sorted(by_id[i], key=lambda r: r["component"])] for i in (None, 2))
    assert a == b


def test_equal_roots_and_missing_rank(spark):
    # the six unit vectors and their opposites: covariance a multiple of the identity in 6 of 8 dimensions
    rows = [(2 * i + s, [float(j == i) * (1 - 2 * s) for j in range(6)] + [0.25, -3.0]) for i in range(6) for s in (0, 1)]
    got = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 12 * 6 and {r["component"] for r in got} == set(range(1, 7))
    w = np.zeros((12, 6))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(w.T @ w / 12, np.eye(6), atol=1e-13) and np.allclose(np.linalg.norm(w, axis=1), math.sqrt(6))
    assert all(abs(r["explained"] - 1 / 6) < 1e-15 and r["identity_error"] < 1e-12 for r in got)


def test_far_values_stay_exact(spark):
    """An offset that swamps doubles, and entries whose products pass 64 bits."""
    base = [(i, [2.0**50 + (i * 7 % 5), 2.0**50 - (i * 3 % 4)]) for i in range(20)]
    got = whiten.whitened(spark.createDataFrame(base, "vec_id long, embedding array<double>")).collect()
    near = whiten.whitened(spark.createDataFrame([(i, [x - 2.0**50 for x in v]) for i, v in base], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, near))
    wide = [(1, [2.0**56, 0.0]), (2, [-(2.0**56), 1.0]), (3, [0.0, 2.0])]
    out = whiten.whitened(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 6 and all(r["deviation"] is None or r["deviation"] > 0 for r in out)
    assert whiten.products(np.array([[2**40, 3], [-(2**40), 5]])).tolist() == [[2**81, -(2**41)], [-(2**41), 34]]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    got = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.count() == 0 and got.columns[0] == "vec_id" and len(got.columns) == 7
