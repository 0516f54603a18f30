"""Flat and dimension sources with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox import schemas


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to ``columns`` where given."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_station_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.STATION_PIXELS)


def decode_paths(raw: DataFrame) -> DataFrame:
    """The text "null" is no projection; the two direction flags hold only for the text TRUE."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name) == "TRUE", F.lit(False))

    return raw.withColumns(
        {
            "projection": F.nullif(F.col("projection"), F.lit("null")),
            "reverseFirstPath": flag("reverseFirstPath"),
            "reverseSecondPath": flag("reverseSecondPath"),
        }
    )


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return decode_paths(spark.read.csv(path, header=True, schema=schemas.PATHS))


def line_stations(spark: SparkSession, lines: Mapping[str, Sequence[str]]) -> DataFrame:
    """A configured ``{line: [station, ...]}`` as rows (line, line_seq, seq, sta), order kept."""
    rows = [(line, i, list(stas)) for i, (line, stas) in enumerate(lines.items())]
    return spark.createDataFrame(rows, "line string, line_seq int, stas array<string>").select(
        "line", "line_seq", F.posexplode("stas").alias("seq", "sta")
    )


def mapping(spark: SparkSession, values: Mapping, schema: str) -> DataFrame:
    """A configured dictionary as a small table; tuple values fill several columns."""
    rows = [(k, *v) if isinstance(v, (tuple, list)) else (k, v) for k, v in values.items()]
    return spark.createDataFrame(rows, schema)


def _typed(features: DataFrame) -> DataFrame:
    kind, coordinates = F.col("geometry.type"), F.col("geometry.coordinates")
    return features.select(
        "properties",
        kind.alias("geometry_type"),
        F.when(kind == "Point", F.from_json(coordinates, "array<double>")).alias("point"),
        F.when(kind == "LineString", F.from_json(coordinates, "array<array<double>>")).alias("line_string"),
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection documents: properties, geometry_type, point, line_string."""
    docs = spark.read.option("wholetext", True).text(path)
    parsed = docs.select(F.from_json("value", schemas.FEATURE_COLLECTION).alias("c"))
    return _typed(parsed.select(F.inline("c.features")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from newline-delimited features, which scale with the number of files and lines."""
    feature = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
    return _typed(spark.read.text(path).select(F.from_json("value", feature).alias("f")).select("f.*"))
