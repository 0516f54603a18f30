"""Dimension joins, line assembly and nearest vertices."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.operators import network
from signalbox.sources import tables

LINES = {"A": ["p", "q", "r"], "B": ["q", "s"], "C": ["t", "zz"]}


@pytest.fixture(scope="module")
def dims(spark):
    coords = {"p": (0.0, 0.0), "q": (1.0, 0.5), "r": (2.0, 1.0), "s": (1.5, 3.0), "t": (9.0, 9.0)}
    return (
        tables.line_stations(spark, LINES),
        tables.mapping(spark, coords, "sta string, lon double, lat double"),
        tables.mapping(spark, {"A": "#111111", "B": "#222222"}, "line string, color string"),
    )


def test_network_features(dims):
    lines, coords, colors = dims
    got = [json.loads(r[0]) for r in network.network_features(lines, coords, colors).collect()]
    strings = {f["properties"]["line"]: f for f in got if f["geometry"]["type"] == "LineString"}
    assert set(strings) == {"A", "B"}  # C has one placed station only
    assert strings["A"]["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 0.5], [2.0, 1.0]]
    points = {f["properties"]["name"]: f["properties"]["color"] for f in got if f["geometry"]["type"] == "Point"}
    assert points == {"A-p": "#111111", "A-q": "#111111", "A-r": "#111111", "B-q": "#222222",
                      "B-s": "#222222", "C-t": "#000000"}


def test_lookups(spark, dims):
    lines, _, _ = dims
    names = spark.createDataFrame([("Upper", 1.0), ("Lower", 2.0)], "name string, x double")
    codes = spark.createDataFrame([("Upper", "q")], "name string, sta string")
    coded = network.lookup_code(names, codes, "name", "sta")
    assert {r["name"]: r["sta"] for r in coded.collect()} == {"Upper": "q", "Lower": None}
    placed = network.first_line_of_station(coded.dropna(subset=["sta"]), lines)
    assert placed.first()["line"] == "A"
    other = network.first_line_of_station(spark.createDataFrame([("??",)], "sta string"), lines)
    assert other.first()["line"] == "UNKNOWN"
    twice = spark.createDataFrame([("p", 2, 5.0), ("p", 1, 7.0), ("q", 1, 1.0)], "sta string, i int, lon double")
    assert {r["sta"]: r["lon"] for r in network.first_per_key(twice, "sta", "i").collect()} == {"p": 7.0, "q": 1.0}
    roads = spark.createDataFrame([(1, "a"), (2, "b")], "ROUTE_ID long, STREET_ENAME string")
    seen = spark.createDataFrame([(2,), (2,), (3,)], "segment_id long")
    assert [r["ROUTE_ID"] for r in network.keep_known(roads, seen, "ROUTE_ID", "segment_id").collect()] == [2]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 9, 10, 23])
def test_long_lines_continue_in_parts(spark, n):
    df = spark.createDataFrame([("L", i, float(i), float(-i)) for i in range(n)], "line string, seq int, x double, y double")
    parts = network.line_strings(df, ["line"], "seq", "x", "y", max_vertices=5, max_rows=4).orderBy("part").collect()
    assert [r["part"] for r in parts] == list(range(len(parts)))
    assert all(2 <= len(r["coordinates"]) <= 5 for r in parts)
    whole = [c for i, r in enumerate(parts) for c in r["coordinates"][1 if i else 0 :]]
    assert whole == ([[float(i), float(-i)] for i in range(n)] if n > 1 else [])
    assert all(a["coordinates"][-1] == b["coordinates"][0] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("kind", ["spread", "clump", "same", "line"])
def test_nearest_vertex(spark, kind):
    rng = np.random.default_rng(3)
    vertices = rng.uniform(0, 1, (400, 2))
    if kind == "clump":
        vertices[:300] = 0.7 + rng.uniform(0, 1e-5, (300, 2))
    if kind == "same":
        vertices[:] = 0.25
    if kind == "line":
        vertices[:, 1] = 3.0
    points = np.vstack([rng.uniform(-0.5, 1.5, (150, 2)), 0.7 + rng.uniform(0, 1e-5, (50, 2)), vertices[:5]])
    frame = lambda a: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, x double, y double")
    got = network.nearest_vertex(
        frame(points).withColumnRenamed("id", "p"), frame(vertices).withColumnRenamed("id", "v"), "p", "v")
    got = {r["p"]: (r["v"], r["distance2"]) for r in got.collect()}
    d = ((points[:, None, :] - vertices[None, :, :]) ** 2).sum(axis=2)
    assert got == {i: (int(d[i].argmin()), d[i].min()) for i in range(len(points))}


def test_nearest_vertex_without_vertices(spark):
    none = spark.createDataFrame([], "v long, x double, y double")
    some = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double")
    got = network.nearest_vertex(some, none, "p", "v")
    assert got.columns == ["p", "v", "distance2"] and [tuple(r) for r in got.collect()] == [(1, None, None)]


def test_points_without_coordinates_stay(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0)], "p long, x double, y double")
    got = network.nearest_vertex(points, spark.createDataFrame([(9, 1.0, 0.0)], "v long, x double, y double"), "p", "v")
    assert sorted(map(tuple, got.collect())) == [(1, 9, 1.0), (2, None, None), (3, None, None)]


def test_long_line_is_one_feature(spark):
    rows = [("L", i, float(i), 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "line string, seq int, x double, y double")
    (line,) = network.line_strings(df, ["line"], "seq", "x", "y", max_rows=4).collect()
    assert line["part"] == 0 and len(line["coordinates"]) == 50


def test_lookup_of_a_whole_forecast(spark):
    from signalbox.operators import serving

    state = spark.createDataFrame([("L", "A", 0.123456, 3, "red"), ("L", "B", None, None, None)], "line string, sta string, risk double, trains int, color string")
    wanted = spark.createDataFrame([("L", "A"), ("L", "B"), ("X", "Y")], "line string, sta string")
    got = serving.lookup(state, wanted, ["line", "sta"], ["risk", "trains", "color"], digits=2)
    assert sorted(map(tuple, got.collect())) == [("L", "A", 0.12, 3, "red", "Success"), ("L", "B", None, None, None, "Not found"), ("X", "Y", None, None, None, "Not found")]
