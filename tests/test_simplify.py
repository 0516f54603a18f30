"""Topology-preserving simplification against a plain version over all pairs of segments, in fractions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.functions import geometry


def side(o, d, q):
    v = (d[0] - o[0]) * (q[1] - o[1]) - (d[1] - o[1]) * (q[0] - o[0])
    return (v > 0) - (v < 0)


def meets(p, q, s, e):
    """Whether two segments share a place that isn't an end of both."""

    def on(a, b, c):
        return side(a, b, c) == 0 and all(min(a[i], b[i]) <= c[i] <= max(a[i], b[i]) for i in (0, 1))

    if side(p, q, s) * side(p, q, e) < 0 and side(s, e, p) * side(s, e, q) < 0:
        return True
    if {p, q} == {s, e} and p != q:
        return True
    return any(on(p, q, c) and c not in (p, q) for c in (s, e)) or any(on(s, e, c) and c not in (s, e) for c in (p, q))


def plain(points, tolerance):
    exact = [tuple(Fraction(float(c)) for c in p) for p in points]
    done, wanted = [0], [len(points) - 1]
    while wanted:
        a, b = done[-1], wanted[-1]
        if b - a > 1:
            chord = points[b] - points[a]
            length = chord @ chord
            off = []
            for k in range(a + 1, b):
                t = min(1.0, max(0.0, ((points[k] - points[a]) @ chord) / length)) if length else 0.0
                rest = points[k] - (points[a] + t * chord)
                off.append(float(rest @ rest))
            others = [*zip(done, done[1:]), *((k, k + 1) for k in range(b, len(points) - 1))]
            if max(off) > tolerance**2 or any(meets(exact[a], exact[b], exact[i], exact[j]) for i, j in others):
                wanted.append(a + 1 + off.index(max(off)))
                continue
        done.append(wanted.pop())
    return done


def crossings(points):
    exact = [tuple(Fraction(float(c)) for c in p) for p in points]
    n = len(points) - 1
    return sum(meets(exact[i], exact[i + 1], exact[j], exact[j + 1]) for i in range(n) for j in range(i + 1, n))


def spiral(n):
    a = np.linspace(0, 6 * np.pi, n)
    return np.stack([a * np.cos(a), a * np.sin(a)], 1)


def comb(n):
    """Teeth that a plain simplification would cut through."""
    out = []
    for i in range(n):
        out += [(i, 0.0), (i + 0.4, 1.0 + 0.1 * (i % 3)), (i + 0.5, 0.05), (i + 0.6, 0.9)]
    return np.array(out[: len(out)] + [(x, y - 0.12) for x, y in reversed(out)], float)


@pytest.mark.parametrize("tolerance", (0.01, 0.2, 0.5, 2.0))
@pytest.mark.parametrize("seed", range(6))
def test_equals_the_plain_version(seed, tolerance):
    rng = np.random.default_rng(seed)
    for line in (rng.normal(0, 1, (25, 2)).cumsum(0), rng.integers(0, 4, (20, 2)).astype(float), spiral(40) + rng.normal(0, 0.05, (40, 2)), comb(4)):
        assert np.flatnonzero(geometry._keep(line, tolerance)).tolist() == plain(line, tolerance)


@pytest.mark.parametrize("tolerance", (0.05, 0.3, 1.0, 4.0))
def test_simple_lines_stay_simple(tolerance):
    for line in (spiral(200), comb(6), np.stack([np.arange(50.0), np.arange(50.0) % 2], 1)):
        assert crossings(line) == 0
        kept = line[geometry._keep(line, tolerance)]
        assert crossings(kept) == 0 and (kept[0] == line[0]).all() and (kept[-1] == line[-1]).all()


def test_plain_simplification_would_cross():
    line = np.array([(0, 0), (4, 0.4), (5, 0), (5, -1), (4.0, 0.3), (3.9, -1.0), (0, -1)], float)
    assert crossings(line) == 0
    assert len(line[geometry._keep(line, 0.45)]) > 4 and crossings(line[geometry._keep(line, 0.45)]) == 0
    assert crossings(line[[0, 2, 3, 4, 5, 6]]) > 0  # what the distance alone would leave


def test_sides_are_exact():
    """Places a rounding error away from a line."""
    o, d = np.array([0.5, 0.5]), np.array([12.0, 12.0])
    eps = 2.0**-53
    q = np.array([[24.0, 24.0], [24.0, 24.0 + 4e-15], [0.5 + eps, 0.5], [0.5, 0.5 + 2 * eps]]).T
    want = [side(tuple(map(Fraction, o)), tuple(map(Fraction, d)), tuple(map(Fraction, p))) for p in q.T]
    assert geometry._side(o, d, q).tolist() == want


def test_long_line_and_odd_lines(spark):
    n = 20_000
    x = np.linspace(0, 100, n)
    line = np.stack([x, np.sin(x) + 1e-4 * np.cos(400 * x)], 1)
    kept = np.flatnonzero(geometry._keep(line, 0.01))
    assert 50 < len(kept) < 2000 and kept[0] == 0 and kept[-1] == n - 1
    rows = [(0, None), (1, []), (2, [[1.0, 2.0]]), (3, [[1.0, 1.0]] * 5), (4, [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]), (5, [[0.0, 0.0], [1.0, 1e-9], [2.0, 0.0]])]
    got = spark.createDataFrame(rows, "i int, g array<array<double>>").orderBy("i").select(geometry.simplify(F.col("g"), 0.1)).collect()
    assert [r[0] for r in got][:3] == [None, [], [[1.0, 2.0]]]
    assert got[5][0] == [[0.0, 0.0], [2.0, 0.0]] and got[4][0][0] == got[4][0][-1] == [0.0, 0.0]
    assert got[3][0][0] == got[3][0][-1] == [1.0, 1.0]
