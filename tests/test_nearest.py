"""Nearest vertices against brute force, in one tree and page by page."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.operators import nearest


def brute(px, py, vx, vy, ids):
    d = (px[:, None] - vx) ** 2 + (py[:, None] - vy) ** 2
    return [min((d[i, j], ids[j]) for j in np.flatnonzero(d[i] == d[i].min())) for i in range(len(px))]


def clouds(kind, n, rng):
    if kind == "even":
        return rng.uniform(-1, 1, (n, 2))
    if kind == "ring":
        a = np.arange(n) * 2 * np.pi / n
        return np.stack([np.cos(a), np.sin(a)], 1)
    if kind == "same":
        return np.full((n, 2), 0.5)
    if kind == "grid":  # many equal distances
        return np.stack(np.divmod(np.arange(n), 37), 1).astype(float)
    return np.concatenate([rng.normal(0, 1e-7, (n // 2, 2)), rng.uniform(-5, 5, (n - n // 2, 2))])


@pytest.mark.parametrize("kind", ("even", "ring", "same", "grid", "clump"))
@pytest.mark.parametrize("n", (1, 63, 64, 65, 3000))
def test_tree_equals_brute_force(kind, n):
    rng = np.random.default_rng(n)
    v = clouds(kind, n, rng)
    ids = rng.permutation(n)
    p = np.concatenate([clouds(kind, 60, rng), rng.normal(0, 1e-3, (40, 2)), v[:20]])
    tree = nearest.Boxes(v[:, 0], v[:, 1], v[:, 0], v[:, 1], ids)
    d, b = tree.nearest(p[:, 0], p[:, 1])
    assert list(zip(d, ids[b])) == brute(p[:, 0], p[:, 1], v[:, 0], v[:, 1], ids)
    for i in range(0, len(p), 17):
        near = tree.within(p[i, 0], p[i, 1], d[i] * 1.5)
        all_d = (p[i, 0] - v[:, 0]) ** 2 + (p[i, 1] - v[:, 1]) ** 2
        assert sorted(near) == sorted(np.flatnonzero(all_d <= d[i] * 1.5)) and list(all_d[near]) == sorted(all_d[near])


def test_few_pairs_at_a_time(monkeypatch):
    v = clouds("ring", 2000, None)
    p = np.random.default_rng(1).normal(0, 1e-9, (50, 2))
    ids = np.arange(2000)
    want = brute(p[:, 0], p[:, 1], v[:, 0], v[:, 1], ids)
    monkeypatch.setattr(nearest, "PAIRS", 4000)
    d, b = nearest.Boxes(v[:, 0], v[:, 1], v[:, 0], v[:, 1], ids).nearest(p[:, 0], p[:, 1])
    assert list(zip(d, b)) == want


def frame(spark, places, name):
    return spark.createDataFrame([(f"n{i:05d}", float(x), float(y)) for i, (x, y) in enumerate(places)], f"{name} string, x double, y double")


@pytest.mark.parametrize("kind", ("ring", "grid", "clump"))
def test_pages_equal_brute_force(spark, kind, monkeypatch):
    """Small pages; most points ask for one page, which is then held by several tasks."""
    monkeypatch.setattr(nearest, "MAX_SENT", 10)
    monkeypatch.setattr(nearest, "PAGE", 50)
    monkeypatch.setattr(nearest, "POINTS_PER_TASK", 40)
    monkeypatch.setattr(nearest, "PAGES_A_ROUND", 2)
    rng = np.random.default_rng(8)
    v = clouds(kind, 1200, rng)
    p = np.concatenate([np.full((150, 2), 0.25), rng.normal(0, 1e-4, (30, 2)), clouds(kind, 80, rng)])
    points = frame(spark, p, "p").union(spark.createDataFrame([("none", None, 1.0)], "p string, x double, y double"))
    got = {r["p"]: (r["distance2"], r["v"]) for r in nearest.nearest_vertex(points, frame(spark, v, "v"), "p", "v").collect()}
    assert got.pop("none") == (None, None)
    want = brute(p[:, 0], p[:, 1], v[:, 0], v[:, 1], [f"n{i:05d}" for i in range(len(v))])
    assert got == {f"n{i:05d}": w for i, w in enumerate(want)}


def test_ring_emits_one_row_a_point(spark):
    """All vertices lie at nearly one distance from all points; the search hands on its answers alone."""
    ring = frame(spark, clouds("ring", 2000, None), "v")
    points = frame(spark, np.random.default_rng(2).normal(0, 1e-6, (50, 2)), "p")
    located = points.select("p", F.col("x").alias("px"), F.col("y").alias("py"))
    places = ring.select("v", F.col("x").alias("vx"), F.col("y").alias("vy"))
    assert nearest._sent(located, places, ring.schema["v"].dataType).count() == 50


@pytest.mark.parametrize("kind", ("even", "ring", "same", "grid", "clump"))
@pytest.mark.parametrize("n", (1, 64, 3000))
def test_search_within_a_known_distance(kind, n, monkeypatch):
    """What is no farther than a known distance is found exactly; else nothing is, and only one way down is looked at."""
    rng = np.random.default_rng(n)
    v = clouds(kind, n, rng)
    ids = rng.permutation(n)
    p = np.concatenate([clouds(kind, 60, rng), rng.normal(0, 1e-3, (40, 2)), v[:20]])
    tree = nearest.Boxes(v[:, 0], v[:, 1], v[:, 0], v[:, 1], ids)
    want = brute(p[:, 0], p[:, 1], v[:, 0], v[:, 1], ids)
    exact = np.array([d for d, _ in want])
    for known in (exact, exact * 2 + 1e-9):
        d, b = tree.nearest(p[:, 0], p[:, 1], known)
        assert list(zip(d, ids[b])) == want
    looked = []
    best_of = nearest.Boxes._best_of
    monkeypatch.setattr(nearest.Boxes, "_best_of", lambda self, level, nodes, px, py: (looked.append(len(nodes)), best_of(self, level, nodes, px, py))[1])
    far = p + 100.0
    d, b = tree.nearest(far[:, 0], far[:, 1], np.ones(len(far)))
    assert np.isnan(d).all() and (b == -1).all() and sum(looked) <= len(far) * len(tree.levels)
