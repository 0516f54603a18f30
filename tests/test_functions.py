"""Scalar functions against hand-worked values, Python's own rounding, and known control points."""

import dataclasses
import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalbox.functions import calendar, geometry, rounding, severity


def test_calendar(spark):
    stamps = ["20240101_065900", "20240101_095900", "20240101_100000", "20240106_170000", "20240106_200000"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    df = df.withColumn("ts", calendar.stamp_to_timestamp("s"))
    got = {r["s"]: (r["hour"], r["day_of_week"], r["is_weekend"], r["is_peak"], r["back"], r["clock"])
           for r in calendar.add_calendar(df, "ts").withColumns(
               {"back": calendar.timestamp_to_stamp("ts"), "clock": calendar.timestamp_to_clock("ts")}).collect()}
    assert [got[s][:4] for s in stamps] == [(6, 0, 0, 0), (9, 0, 0, 1), (10, 0, 0, 0), (17, 5, 1, 1), (20, 5, 1, 0)]
    assert all(v[4] == s for s, v in got.items()) and got[stamps[0]][5] == "2024-01-01 06:59:00"
    row = spark.createDataFrame([("2024-01-02", "08:00:30"), ("x", "y")], "d string, t string").select(
        calendar.civil_timestamp("d", "t")).collect()
    assert [r[0] for r in row] == [datetime(2024, 1, 2, 8, 0, 30), None]


NUMBERS = [0.35, 0.25, 2.675, 1.005, 0.5, 1.5, 2.5, 1e-9, 12.25, 0.15, 123456.785, 1e17, -2.5, -0.35, 0.045]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_exact_round_equals_python(spark, digits):
    rng = np.random.default_rng(1)
    xs = NUMBERS + list(np.round(rng.uniform(0, 400, 4000), digits + 1)) + list(rng.uniform(-5, 5, 500))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in df.select("x", rounding.exact_round(F.col("x"), digits).alias("y")).collect():
        assert r["y"] == round(r["x"], digits), r


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=50))
def test_exact_round_property(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(r["y"] == round(r["x"], 1) for r in df.select("x", rounding.exact_round(F.col("x"), 1).alias("y")).collect())


def test_percent_and_count(spark):
    df = spark.createDataFrame([(0.1234,), (0.0025,), (1.0,), (0.0,)], "x double")
    assert [r[0] for r in df.select(rounding.percent_text(F.col("x"))).collect()] == ["12.3%", "0.3%", "100.0%", "0.0%"]
    df = spark.createDataFrame([(2.5,), (3.5,), (-1.2,)], "x double")
    assert [r[0] for r in df.select(rounding.round_count(F.col("x"))).collect()] == [2, 4, 0]


def test_severity(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.01,), (20.0,), (20.01,), (None,)], "x double")
    df = df.withColumn("t", severity.road_severity(F.col("x"))).withColumns(severity.road_style(F.col("t")))
    rows = df.collect()
    assert [r["t"] for r in rows] == ["green", "yellow", "orange", "orange", "red", "grey"]
    assert (rows[0]["color"], rows[0]["weight"], rows[0]["opacity"]) == severity.ROAD_STYLES["green"]
    df = spark.createDataFrame([(0.3,), (0.31,), (0.7,), (0.71,)], "x double")
    assert [r[0] for r in df.select(severity.rail_severity(F.col("x"))).collect()] == ["green", "yellow", "yellow", "red"]
    text = df.limit(1).select(severity.event_text(F.col("x"), F.lit(12.0), F.lit(3))).first()[0]
    assert text == "Risk: 30.0% | Est. 12m | Affects ~3 trains"


def test_pixels_to_degrees(spark):
    df = spark.createDataFrame([(0.0, 10.0), (50.0, 20.0), (100.0, 30.0)], "x double, y double")
    got = [(r["lon"], r["lat"]) for r in geometry.pixels_to_degrees(df, "x", "y").orderBy("x").collect()]
    assert got[0] == pytest.approx((113.93, 22.53)) and got[2] == pytest.approx((114.27, 22.24))
    assert got[1] == pytest.approx((114.10, 22.385))
    one = geometry.pixels_to_degrees(df.limit(1), "x", "y").first()
    assert one["lon"] is None


UTM17 = geometry.TransverseMercator(6378137.0, 298.257223563, 0.0, -81.0, 0.9996, 500000.0, 0.0)
CITY = geometry.TransverseMercator(
    6378388.0, 297.0, 22 + 18 / 60 + 43.68 / 3600, 114 + 10 / 60 + 42.80 / 3600, 1.0, 836694.05, 819069.80
)


def forward(grid, lon, lat):
    """Independent forward projection: Snyder's classical series."""
    f = 1 / grid.inverse_flattening
    e2 = f * (2 - f)

    def meridian(p):
        return grid.semi_major * (
            (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p
            - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p)
            + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p)
            - 35 * e2**3 / 3072 * math.sin(6 * p)
        )

    p, ep2 = math.radians(lat), e2 / (1 - e2)
    n = grid.semi_major / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t, c = math.tan(p) ** 2, ep2 * math.cos(p) ** 2
    a = math.radians(lon - grid.lon0) * math.cos(p)
    x = grid.scale * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a**5 / 120)
    y = grid.scale * (
        meridian(p) - meridian(math.radians(grid.lat0))
        + n * math.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24
                             + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a**6 / 720)
    )
    return x + grid.false_easting, y + grid.false_northing


def test_reproject(spark):
    df = spark.createDataFrame([([[630084.0, 4833438.0]],)], "g array<array<double>>")
    lon, lat = df.select(geometry.reproject(F.col("g"), UTM17)).first()[0][0]
    # a published control point, known to the metre
    assert (lon, lat) == pytest.approx((-79.387139, 43.642567), abs=2e-5)
    places = [(114.178556, 22.312133), (114.0, 22.25), (114.3, 22.5), (113.85, 22.2)]
    df = spark.createDataFrame([([list(forward(CITY, *p)) for p in places],)], "g array<array<double>>")
    for got, want in zip(df.select(geometry.reproject(F.col("g"), CITY)).first()[0], places):
        assert got == pytest.approx(want, abs=1e-8)
    origin = spark.createDataFrame([([[836694.05, 819069.80]],)], "g array<array<double>>")
    assert origin.select(geometry.reproject(F.col("g"), CITY)).first()[0][0] == pytest.approx(
        (CITY.lon0, CITY.lat0), abs=1e-12)


def test_reproject_to_wgs84(spark):
    datum = geometry.Datum(-162.619, -276.959, -161.764, 0.067753, -2.243649, -1.158827, -1.094246)
    grid = dataclasses.replace(CITY, datum=datum)
    df = spark.createDataFrame([([[836694.05, 819069.80], [800000.0, 840000.0]],)], "g array<array<double>>")
    own, moved = df.select(geometry.reproject(F.col("g"), CITY), geometry.reproject(F.col("g"), grid)).first()
    for before, after in zip(own, moved):
        # the published offsets between the two datums, known to a tenth of a second
        assert (after[0] - before[0]) * 3600 == pytest.approx(8.8, abs=0.1)
        assert (after[1] - before[1]) * 3600 == pytest.approx(-5.5, abs=0.1)
    no_shift = dataclasses.replace(UTM17, datum=geometry.Datum(0.0, 0.0, 0.0))
    df = spark.createDataFrame([([[630084.0, 4833438.0]],)], "g array<array<double>>")
    a, b = df.select(geometry.reproject(F.col("g"), UTM17), geometry.reproject(F.col("g"), no_shift)).first()
    assert a[0] == pytest.approx(b[0], abs=1e-11)


def test_simplify(spark):
    lines = [
        [[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [2.0, 5.0], [2.001, 9.0], [2.0, 10.0]],
        [[0.0, 0.0], [1.0, 1.0]],
        [[0.0, 0.0], [3.0, 4.0], [0.0, 0.0]],
        None,
    ]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, g array<array<double>>")
    got = [r[0] for r in df.orderBy("i").select(geometry.simplify(F.col("g"), 0.1)).collect()]
    assert got == [[[0.0, 0.0], [2.0, 0.0], [2.0, 10.0]], lines[1], lines[2], None]


def test_paths(spark):
    text = "M1,2L3,4C5,6,7,8,9,10M11 12L 13.5 -14"
    df = spark.createDataFrame([(text,)], "p string")
    parsed = geometry.parse_path(F.col("p"))
    subs = df.select(parsed.alias("s")).first()["s"]
    assert [[(s["kind"], s["points"]) for s in sub] for sub in subs] == [
        [("", [[1.0, 2.0]]), ("L", [[3.0, 4.0]]), ("C", [[5.0, 6.0], [7.0, 8.0], [9.0, 10.0]])],
        [("", [[11.0, 12.0]]), ("L", [[13.5, -14.0]])],
    ]
    assert df.select(geometry.path_text(parsed)).first()[0] == "M1,2L3,4C5,6,7,8,9,10M11,12L13.5,-14"
    assert df.select(geometry.path_text(geometry.midpoint_controls(parsed))).first()[0] == (
        "M1,2L3,4C6,7,6,7,9,10M11,12L13.5,-14")
    ends = {(r["sub"], r["pos"]): (r["kind"], r["x"], r["y"]) for r in geometry.path_vertices(df, "p").collect()}
    assert ends == {(0, 0): ("", 1.0, 2.0), (0, 1): ("L", 3.0, 4.0), (0, 2): ("C", 9.0, 10.0),
                    (1, 0): ("", 11.0, 12.0), (1, 1): ("L", 13.5, -14.0)}
