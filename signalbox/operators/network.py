"""Joins and assembly of network dimensions: lines, stations, colours, roads, vertices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.operators.nearest import nearest_vertex  # noqa: F401  (part of this module's interface)
from signalbox.operators.series import row_positions
from signalbox.operators.split import Series, plan_split
from signalbox.sources.sinks import feature_json

# What stands in for a missing colour or line.
DEFAULT_COLOR = "#000000"
UNKNOWN_LINE = "UNKNOWN"


def keep_known(roads: DataFrame, observed: DataFrame, road_id: str, observed_id: str) -> DataFrame:
    """Roads whose id occurs in the observations. Only distinct ids of the large side are shuffled."""
    known = observed.select(F.col(observed_id).alias("__id")).distinct()
    return roads.join(known, roads[road_id] == known["__id"], "left_semi")


def first_per_key(dim: DataFrame, key: str, order: str) -> DataFrame:
    """One dimension row per key: the first in ``order``."""
    others = [c for c in dim.columns if c != key]
    first = dim.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("__f"))
    return first.select(key, "__f.*")


def lookup_code(df: DataFrame, codes: DataFrame, name: str, code: str) -> DataFrame:
    """Left lookup: names without a code keep a null."""
    return df.join(codes.select(name, code), name, "left")


def with_color(df: DataFrame, colors: DataFrame, line: str = "line", default: str = DEFAULT_COLOR) -> DataFrame:
    joined = df.join(colors.select(line, F.col("color").alias("__color")), line, "left")
    return joined.withColumn("color", F.coalesce("__color", F.lit(default))).drop("__color")


def first_line_of_station(stations: DataFrame, lines: DataFrame, sta: str = "sta") -> DataFrame:
    """Adds the first line (in configured order) that contains the station."""
    first = lines.groupBy(sta).agg(F.min_by("line", "line_seq").alias("line"))
    joined = stations.join(first, sta, "left")
    return joined.withColumn("line", F.coalesce("line", F.lit(UNKNOWN_LINE)))


def line_vertices(lines: DataFrame, coords: DataFrame, sta: str = "sta") -> DataFrame:
    """Stations of each line with coordinates, in order; stations without coordinates drop out."""
    return lines.join(coords, sta, "inner")


def line_strings(
    vertices: DataFrame,
    keys: Sequence[str],
    order: str,
    x: str,
    y: str,
    max_vertices: int | None = None,
    tie: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Ordered vertices to line geometries; lines with a single vertex drop out.

    A line is one geometry, part 0, whatever its length. Only if ``max_vertices`` is given does a longer line
    continue in parts 1, 2, ...; each starts with the vertex that ended the one before, so nothing is lost.
    """
    tie = list(tie)
    split = plan_split(vertices, keys, order, tie, max_rows)
    s = Series(vertices.select(*dict.fromkeys([*keys, order, *tie, x, y])), keys, order, tie, split)
    rows = row_positions(s, s.df, "__i", "__n").where(F.col("__n") > 1)
    if max_vertices is None:
        rows = s.done(rows.withColumn("part", F.lit(0)))
        return _assembled(rows, keys, x, y)
    step = max_vertices - 1
    i = F.col("__i") - 1
    part = F.floor(i / step)
    # A vertex that ends a part (and is not the line's last) also starts the next one.
    joint = (i % step == 0) & (i > 0)
    parts = (
        F.when(~joint, F.array(part))
        .when(F.col("__i") == F.col("__n"), F.array(part - 1))
        .otherwise(F.array(part - 1, part))
    )
    return _assembled(s.done(rows.withColumn("part", F.explode(parts))), keys, x, y)


def _assembled(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    grouped = rows.groupBy(*keys, F.col("part").cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("__i", F.col(x).alias("x"), F.col(y).alias("y")))).alias("__v")
    )
    return grouped.select(
        *keys, "part", F.transform("__v", lambda v: F.array(v["x"], v["y"])).alias("coordinates")
    )


def line_features(strings: DataFrame, colors: DataFrame) -> DataFrame:
    """Coloured line features as GeoJSON text; a part after the first names its number."""
    colored = with_color(strings, colors)
    part = [F.when(F.col("part") > 0, F.col("part")).alias("part")] if "part" in strings.columns else []
    properties = F.struct("line", F.lit("LineString").alias("type"), "color", *part)
    return colored.select(feature_json(properties, "LineString", F.col("coordinates")).alias("feature"))


def point_features(points: DataFrame, colors: DataFrame) -> DataFrame:
    """Coloured station features as GeoJSON text, from rows (line, sta, lon, lat)."""
    colored = with_color(points, colors)
    properties = F.struct(
        "line", "sta", F.concat_ws("-", "line", "sta").alias("name"), F.lit("Point").alias("type"), "color"
    )
    return colored.select(feature_json(properties, "Point", F.array("lon", "lat")).alias("feature"))


def network_features(lines: DataFrame, coords: DataFrame, colors: DataFrame) -> DataFrame:
    """All line features and one point feature per (line, station)."""
    placed = line_vertices(lines, coords)
    strings = line_strings(placed, ["line"], "seq", "lon", "lat")
    return line_features(strings, colors).unionByName(point_features(placed, colors))
