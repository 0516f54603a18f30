"""Declared schemas of every feed and table; nothing is inferred (streams need that)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- nested snapshot documents -------------------------------------------------------------

ROAD_SNAPSHOT = (
    "date string, time string, "
    "segments struct<segment: array<struct<segment_id: string, speed: string, valid: string>>>"
)

# A train is a map, not a struct, so that "no such field" and "field is null" stay apart.
RAIL_STATION = (
    "struct<isdelay: string, "
    "data: map<string, struct<UP: array<map<string, string>>, DOWN: array<map<string, string>>>>>"
)
RAIL_SNAPSHOT = f"collected_at string, data map<string, map<string, {RAIL_STATION}>>"

# ---- network dimensions --------------------------------------------------------------------

STATION_PIXELS = (
    "name string, x_projection double, y_projection double, "
    "x_real double, y_real double, color string"
)
PATHS = (
    "name string, path string, color string, stroke_width string, class string, "
    "projection string, reverseFirstPath string, reverseSecondPath string"
)
# Feature collections are read with the geometry left as text, because points and lines nest
# coordinates to different depths; ``sources.tables.read_geojson`` types it per geometry kind.
FEATURE_COLLECTION = (
    "type string, features array<struct<type: string, properties: map<string, string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
