"""Whitening against numpy, exact integers and polynomials with known roots."""

import math
from fractions import Fraction

import numpy as np
import pytest

from signalbox.llm import whitening
from signalbox.llm.queries import op12_whitening

DATA = "/root/testdata/sf0.001"


def from_roots(roots):
    c = [1]
    for r in roots:
        c = [0, *c]
        for i in range(len(c) - 1):
            c[i] -= r * c[i + 1]
    return c


@pytest.mark.parametrize("roots", ([7, 7, 5, 3, 3, 3, 0], [9, 5, 4, 3, 1], [0, 0, 2], [10**30, 10**30 - 1, 10**30 - 1, 4], [1, 1, 1, 1, 1], [0, 0]))
def test_roots_with_multiplicities(roots):
    found = whitening.largest_roots(from_roots(roots), 4)
    flat = [r.value for r in found for _ in range(r.multiplicity)]
    want = sorted((r for r in roots if r), reverse=True)
    assert all(abs(a / b - 1) < Fraction(1, 1 << 190) for a, b in zip(flat, want))
    assert len(flat) >= min(4, len(want))
    assert all(r.multiplicity == roots.count(round(r.value)) for r in found)


def test_roots_close_together():
    # 2^60 (x - 1)(x - 1 - 2^-60), scaled to integers
    n = 1 << 60
    found = whitening.largest_roots(from_roots([n, n + 1]), 2)
    assert [r.multiplicity for r in found] == [1, 1] and round(found[0].value) == n + 1 and round(found[1].value) == n


def exact_polynomial(a):
    """Faddeev-LeVerrier over the integers."""
    d, a = len(a), np.array(a, object)
    c, m = [1], np.zeros((d, d), object)
    one = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a @ m + c[-1] * one
        c.append(-sum((a @ m)[i][i] for i in range(d)) // k)
    return c[::-1]


@pytest.mark.parametrize("d", (1, 2, 3, 7, 12))
def test_characteristic_polynomial_is_exact(spark, d):
    random = np.random.default_rng(d)
    x = random.integers(-300, 300, (d + 3, d))
    x[:, : d // 3] = 0  # zero pivots
    a = (x.T @ x).tolist()
    assert whitening.characteristic(spark, a) == exact_polynomial(a)
    wide = [[v * 10**40 for v in row] for row in a]
    assert whitening.characteristic(spark, wide) == exact_polynomial(wide)


def test_primes():
    found = whitening.primes(10**60)
    assert found[0] == 2**31 - 1 and len(found) == len(set(found)) and math.prod(found) > 10**60
    assert all(p % q for p in found for q in range(3, 46341, 2))


def test_gram_is_exact_at_any_size():
    random = np.random.default_rng(2)
    for top in (100, 1 << 27, 1 << 40, (1 << 63) - 1):
        x = random.integers(-top, top, (20, 3))
        assert (whitening.gram(x) == x.astype(object).T @ x.astype(object)).all()
    for v in (0, 1, -1, 1 << 48, -(1 << 48), 3**90, -(3**90)):
        assert sum(limb << whitening.LIMB * place for place, limb in whitening._limbs(v)) == v


def check(rows, x, components=4):
    """rows by (key, component) against numpy on integer vectors by key."""
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(x) * components
    for c in range(components):
        w = {k: (v - sums / n) @ vectors[:, c] / math.sqrt(values[c]) for k, v in x.items()}
        side = math.copysign(1, sum(w[k] * got[k, c + 1]["whitened"] for k in x))
        for k, v in x.items():
            r = got[k, c + 1]
            assert r["whitened"] * side == pytest.approx(w[k], abs=1e-9)
            assert r["n"] == n and r["deviation"] == int(((n * v.astype(object) - sums) ** 2).sum())
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_query_equals_numpy(spark):
    x = {r["vec_id"]: np.floor(256 * np.array(r["embedding"])).astype(np.int64) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    check(op12_whitening(spark, DATA).collect(), x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = {i: [float(v) for v in row] for i, row in enumerate(np.random.default_rng(4).normal(0, 3, (30, 5)))}
    rows = [(k, v, 1, "a") for k, v in good.items()] + [(3, good[3], 1, "a")]
    rows += [(100, None, 1, "a"), (101, [1.0, None, 1.0, 1.0, 1.0], 1, "a"), (102, [nan] * 5, 1, "a"), (103, [1.0, inf, 0.0, 0.0, 0.0], 1, "a"), (104, [], 1, "a"), (105, [1.0], 1, "a")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, x int, o0 string")
    out = whitening.whiten(df, whitening.fit(df)).collect()
    again = [r for r in out if r["vec_id"] == 3]
    assert len(again) == 8 and len(set(again)) == 4  # a repeated row counts once in the fit
    check([r for r in out if r["vec_id"] != 3] + list(set(again)), {k: np.floor(256 * np.array(v)).astype(np.int64) for k, v in good.items()})
    for few in (df.filter("false"), df.filter("vec_id = 3"), df.filter("vec_id > 99")):
        assert whitening.whiten(few, whitening.fit(few)).collect() == []
    keyless = df.selectExpr("cast(null as int) as vec_id", "embedding")
    assert len(whitening.whiten(keyless, whitening.fit(keyless)).collect()) == 31 * 4


def test_equal_and_missing_directions(spark):
    # Two directions with one eigenvalue, a third smaller, and a fourth without any spread.
    rows = [(i, [a, b, c, 7.0]) for i, (a, b, c) in enumerate((a, b, c) for a in (-2.0, 2.0) for b in (-2.0, 2.0) for c in (-1.0, 1.0))]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    model = whitening.fit(df)
    assert [float(e) for e in model.eigenvalues] == pytest.approx([512.0**2, 512.0**2, 256.0**2], rel=1e-15)
    assert np.allclose(model.components @ model.components.T, np.eye(3), atol=1e-15) and model.identity_error < 1e-12
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id int, embedding array<double>")
    out = whitening.whiten(huge, whitening.fit(huge)).collect()
    assert len(out) == 6 and all(r["deviation"] is None for r in out if r["vec_id"] < 3)
