"""Geometry as column expressions over ``array<array<double>>`` vertices and path texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.severity import number_text

# The map window that the extreme pixels are placed on. Pixel rows grow downwards, so
# the smallest y is the northern edge.
LON_WINDOW = (113.93, 114.27)
LAT_WINDOW = (22.53, 22.24)
# Fixed value: how far (in degrees) a simplified line may stray.
SIMPLIFY_TOLERANCE = 0.00005


# ---- pixels to degrees -----------------------------------------------------------------------


def pixels_to_degrees(
    df: DataFrame, x: str, y: str, lon_window=LON_WINDOW, lat_window=LAT_WINDOW
) -> DataFrame:
    """Adds lon and lat by mapping the table's x and y ranges linearly onto a window.

    The four extremes are a scalar subquery: computed once, with a map-side combined aggregate.
    """
    range_of = df.agg(
        F.struct(
            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
        )
    ).scalar()
    west, east = lon_window
    north, south = lat_window
    placed = df.withColumn("__b", range_of)
    x0, x1, y0, y1 = (F.col(f"__b.{n}").cast("double") for n in ("x0", "x1", "y0", "y1"))
    across = F.try_divide(F.col(x) - x0, x1 - x0)
    down = F.try_divide(F.col(y) - y1, y0 - y1)
    return placed.withColumns(
        {
            "lon": F.lit(west) + across * F.lit(east - west),
            "lat": F.lit(south) + down * F.lit(north - south),
        }
    ).drop("__b")


# ---- projected metres to degrees -------------------------------------------------------------


# The ellipsoid that web maps use.
WGS84_SEMI_MAJOR, WGS84_INVERSE_FLATTENING = 6378137.0, 298.257223563


@dataclass(frozen=True)
class Datum:
    """Shift of a datum to WGS84: metres, arc seconds (position vector rotation), parts per million."""

    dx: float
    dy: float
    dz: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of a projected grid: ellipsoid, origin, scale and false origin."""

    semi_major: float
    inverse_flattening: float
    lat0: float
    lon0: float
    scale: float
    false_easting: float
    false_northing: float
    datum: Datum | None = None


def _kruger(grid: TransverseMercator) -> tuple[float, float, list[float], list[float]]:
    """Rectifying radius, eccentricity, and the series for the inverse and the forward direction."""
    f = 1 / grid.inverse_flattening
    n = f / (2 - f)
    radius = grid.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, math.sqrt(f * (2 - f)), beta, alpha


def _origin_northing(grid: TransverseMercator) -> float:
    """Rectified latitude of the grid's origin."""
    _, e, _, alpha = _kruger(grid)
    s = math.sin(math.radians(grid.lat0))
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    xi = math.atan(t)
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha))


def grid_to_degrees(x: Column, y: Column, grid: TransverseMercator) -> Column:
    """Grid coordinates to ``array(lon, lat)`` on the grid's own datum (inverse Krueger series)."""
    radius, e, beta, _ = _kruger(grid)
    xi = (y - F.lit(grid.false_northing)) / F.lit(grid.scale * radius) + F.lit(_origin_northing(grid))
    eta = (x - F.lit(grid.false_easting)) / F.lit(grid.scale * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta1 = eta1 - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    # Conformal latitude back to geodetic: fixed-point steps converge by a factor of e^2 each.
    conformal = F.asinh(F.sin(xi1) / F.sqrt(F.pow(F.sinh(eta1), 2) + F.pow(F.cos(xi1), 2)))
    sine = F.tanh(conformal)
    for _ in range(5):
        sine = F.tanh(conformal + F.lit(e) * F.atanh(F.lit(e) * sine))
    lat = F.degrees(F.asin(sine))
    lon = F.lit(grid.lon0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.array(lon, lat)


def _geocentric(place: Column, semi_major: float, flattening: float) -> Column:
    """``array(lon, lat)`` in degrees to ``array(x, y, z)`` in metres, on the ellipsoid's surface."""
    lon, lat = F.radians(place[0]), F.radians(place[1])
    square = flattening * (2 - flattening)
    radius = F.lit(semi_major) / F.sqrt(1 - F.lit(square) * F.pow(F.sin(lat), 2))
    return F.array(
        radius * F.cos(lat) * F.cos(lon), radius * F.cos(lat) * F.sin(lon), radius * F.lit(1 - square) * F.sin(lat)
    )


def _shifted(p: Column, datum: Datum) -> Column:
    turn = [math.radians(r / 3600) for r in (datum.rx, datum.ry, datum.rz)]
    rx, ry, rz = map(F.lit, turn)
    grow = F.lit(1 + datum.ppm * 1e-6)
    return F.array(
        F.lit(datum.dx) + grow * (p[0] - rz * p[1] + ry * p[2]),
        F.lit(datum.dy) + grow * (rz * p[0] + p[1] - rx * p[2]),
        F.lit(datum.dz) + grow * (p[2] - ry * p[0] + rx * p[1]),
    )


def _surface(p: Column, semi_major: float, flattening: float) -> Column:
    """``array(x, y, z)`` to ``array(lon, lat)`` (Bowring's formula: exact to far below a millimetre near the surface)."""
    square = flattening * (2 - flattening)
    semi_minor = semi_major * (1 - flattening)
    across = F.sqrt(p[0] * p[0] + p[1] * p[1])
    reduced = F.atan2(p[2] * F.lit(semi_major), across * F.lit(semi_minor))
    lat = F.atan2(
        p[2] + F.lit(square / (1 - square) * semi_minor) * F.pow(F.sin(reduced), 3),
        across - F.lit(square * semi_major) * F.pow(F.cos(reduced), 3),
    )
    return F.array(F.degrees(F.atan2(p[1], p[0])), F.degrees(lat))


def reproject(vertices: Column, grid: TransverseMercator) -> Column:
    """Every vertex of a line from grid metres to degrees: on WGS84 if the grid has a datum shift, else on its own datum."""
    placed = F.transform(vertices, lambda v: grid_to_degrees(F.get(v, F.lit(0)), F.get(v, F.lit(1)), grid))
    if grid.datum is None:
        return placed
    # One array pass a step, so that no step is written out several times inside the next.
    metres = F.transform(placed, lambda v: _geocentric(v, grid.semi_major, 1 / grid.inverse_flattening))
    moved = F.transform(metres, lambda p: _shifted(p, grid.datum))
    return F.transform(moved, lambda p: _surface(p, WGS84_SEMI_MAJOR, 1 / WGS84_INVERSE_FLATTENING))


# ---- simplification --------------------------------------------------------------------------


#: Segments that share a bounding box in the search for crossings.
BLOCK = 64


def _side(o: np.ndarray, d: np.ndarray, q: np.ndarray) -> np.ndarray:
    """On which side of the line from ``o`` to ``d`` the places ``q`` lie (1, 0, -1); exact for all doubles.

    The rounded determinant is right while it exceeds its own error bound; the others are computed as fractions.
    """
    left, right = (d[0] - o[0]) * (q[1] - o[1]), (d[1] - o[1]) * (q[0] - o[0])
    left, right = np.broadcast_arrays(left, right)
    det = left - right
    out = np.sign(det)
    for i in np.flatnonzero(~(np.abs(det) > 4e-16 * (np.abs(left) + np.abs(right)))):
        ox, oy, dx, dy, qx, qy = (Fraction(float(np.broadcast_to(v, det.shape)[i])) for v in (*o, *d, *q))
        exact = (dx - ox) * (qy - oy) - (dy - oy) * (qx - ox)
        out[i] = (exact > 0) - (exact < 0)
    return out


def _crosses(p: np.ndarray, q: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
    """Whether the segment from ``p`` to ``q`` meets one of the others anywhere but in a common end."""
    s, e = starts.T, ends.T
    side_s, side_e, side_p, side_q = _side(p, q, s), _side(p, q, e), _side(s, e, p), _side(s, e, q)
    meets = (side_s * side_e < 0) & (side_p * side_q < 0)

    def inside(place, side, a, b):
        """A place on a segment's line that lies on the segment and is not one of its ends."""
        between = (np.minimum(a, b) <= place).all(0) & (place <= np.maximum(a, b)).all(0)
        return (side == 0) & between & ~(place == a).all(0) & ~(place == b).all(0)

    p, q = p[:, None], q[:, None]
    for place, side in ((s, side_s), (e, side_e)):
        meets |= inside(place, side, p, q)
    for place, side in ((p, side_p), (q, side_q)):
        meets |= inside(place, side, s, e)
    same = ((s == p) & (e == q)).all(0) | ((s == q) & (e == p)).all(0)
    return bool((meets | same & ~(p == q).all()).any())


class _Segments:
    """Segments in blocks with bounding boxes; more can be added at the end."""

    def __init__(self, capacity: int) -> None:
        self.starts, self.ends, self.n = np.empty((capacity, 2)), np.empty((capacity, 2)), 0
        self.low, self.high = np.full((2, -(-capacity // BLOCK)), np.inf), np.full((2, -(-capacity // BLOCK)), -np.inf)

    def add(self, starts: np.ndarray, ends: np.ndarray) -> None:
        at, many = self.n, len(starts)
        self.starts[at : at + many], self.ends[at : at + many] = starts, ends
        blocks = np.arange(at, at + many) // BLOCK
        for i in (0, 1):
            np.minimum.at(self.low[i], blocks, np.minimum(starts[:, i], ends[:, i]))
            np.maximum.at(self.high[i], blocks, np.maximum(starts[:, i], ends[:, i]))
        self.n += many

    def crossed(self, p: np.ndarray, q: np.ndarray, first: int = 0) -> bool:
        """Whether one of the segments from the ``first`` on is crossed by that from ``p`` to ``q``."""
        low, high = np.minimum(p, q), np.maximum(p, q)
        block = first // BLOCK
        near = (self.low[:, block:] <= high[:, None]).all(0) & (self.high[:, block:] >= low[:, None]).all(0)
        for b in np.flatnonzero(near) + block:
            a, z = max(first, b * BLOCK), min(self.n, (b + 1) * BLOCK)
            starts, ends = self.starts[a:z], self.ends[a:z]
            close = (np.minimum(starts, ends) <= high).all(1) & (np.maximum(starts, ends) >= low).all(1)
            if close.any() and _crosses(p, q, starts[close], ends[close]):
                return True
        return False


def _keep(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of one line stay.

    From the first vertex on, the stretch up to the next vertex wanted becomes one segment if no vertex between is off
    by more than the tolerance and the segment crosses nothing: neither what is already decided, before the
    stretch, nor the given line behind it. Else the farthest vertex of the stretch is wanted first.
    """
    done, wanted, last = [0], [len(points) - 1], len(points) - 1
    given, kept = _Segments(last), _Segments(last)
    given.add(points[:-1], points[1:])
    while wanted:
        a, b = done[-1], wanted[-1]
        start, end = points[a], points[b]
        if b - a > 1:
            inner, chord = points[a + 1 : b], end - start
            length = chord @ chord
            share = np.clip((inner - start) @ chord / length, 0, 1) if length else np.zeros(len(inner))
            off = inner - (start + share[:, None] * chord)
            distance = (off * off).sum(axis=1)
            far = int(distance.argmax())
            if distance[far] > tolerance * tolerance or kept.crossed(start, end) or b < last and given.crossed(start, end, b):
                wanted.append(a + 1 + far)
                continue
        kept.add(start[None], end[None])
        done.append(wanted.pop())
    keep = np.zeros(len(points), dtype=bool)
    keep[done] = True
    return keep


def simplify(vertices: Column, tolerance: float = SIMPLIFY_TOLERANCE) -> Column:
    """Drops vertices closer than ``tolerance`` to the simplified line; both ends stay, and a line that doesn't cross
    itself never does afterwards.

    The split order depends on the data, which built-in functions cannot express; one Arrow batch of
    lines goes through Python at a time.
    """

    @F.pandas_udf("array<array<double>>")
    def simplified(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(line):
            if line is None or len(line) < 3:
                return line
            points = np.vstack(line)
            return points[_keep(points, tolerance)].tolist()

        for lines in batches:
            yield lines.map(one)

    return simplified(vertices)


# ---- path texts ------------------------------------------------------------------------------

SUBPATHS = "array<array<struct<kind: string, points: array<array<double>>>>>"


def parse_path(path: Column) -> Column:
    """A path text as subpaths of segments: kind '' (start), 'L' (one point) or 'C' (three points)."""

    def points(numbers: Column, kind: Column) -> Column:
        coords = F.transform(
            F.split(F.trim(F.regexp_replace(numbers, r"[\s,]+", " ")), " "), lambda t: t.try_cast("double")
        )
        pairs = F.when(kind == "C", F.sequence(F.lit(1), F.lit(5), F.lit(2))).otherwise(F.array(F.lit(1)))
        return F.transform(pairs, lambda i: F.array(F.get(coords, i - 1), F.get(coords, i)))

    def segments(subpath: Column) -> Column:
        kinds = F.regexp_extract_all(subpath, F.lit("([LC]?)([^LC]+)"), 1)
        numbers = F.regexp_extract_all(subpath, F.lit("([LC]?)([^LC]+)"), 2)
        return F.zip_with(
            kinds, numbers, lambda k, n: F.struct(k.alias("kind"), points(n, k).alias("points"))
        )

    subpaths = F.split(path, "M")
    return F.transform(F.slice(subpaths, F.lit(2), F.greatest(F.lit(0), F.size(subpaths) - 1)), segments)


def path_text(subpaths: Column) -> Column:
    """The inverse of ``parse_path``."""

    def segment(s: Column) -> Column:
        pairs = F.transform(
            s["points"], lambda p: F.concat(number_text(F.get(p, F.lit(0))), F.lit(","), number_text(F.get(p, F.lit(1))))
        )
        return F.concat(s["kind"], F.array_join(pairs, ","))

    texts = F.transform(subpaths, lambda sub: F.array_join(F.transform(sub, segment), ""))
    return F.concat(F.lit("M"), F.array_join(texts, "M"))


def end_point(segment: Column) -> Column:
    """Where a segment arrives: its last point."""
    return F.element_at(segment["points"], -1)


def midpoint_controls(subpaths: Column) -> Column:
    """Sets both control points of every curve to the middle between its end and the previous end."""

    def one(sub: Column) -> Column:
        def segment(s: Column, i: Column) -> Column:
            here, before = end_point(s), end_point(F.get(sub, i - 1))
            middle = F.array(
                *[(F.get(here, F.lit(j)) + F.get(before, F.lit(j))) / 2 for j in (0, 1)]
            )
            curved = (s["kind"] == "C") & (i > 0)
            return F.struct(
                s["kind"].alias("kind"),
                F.when(curved, F.array(middle, middle, here)).otherwise(s["points"]).alias("points"),
            )

        return F.transform(sub, segment)

    return F.transform(subpaths, one)


def path_vertices(df: DataFrame, path: str) -> DataFrame:
    """One row per segment of the path text: sub, pos (both from 0), kind, and the end point x, y."""
    subs = df.select(*df.columns, F.posexplode(parse_path(F.col(path))).alias("sub", "__s"))
    rows = subs.select(*df.columns, "sub", F.posexplode("__s").alias("pos", "__v"))
    end = end_point(F.col("__v"))
    return rows.select(
        *df.columns,
        "sub",
        "pos",
        F.col("__v.kind").alias("kind"),
        F.get(end, F.lit(0)).alias("x"),
        F.get(end, F.lit(1)).alias("y"),
    )
