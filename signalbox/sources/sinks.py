"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.session import work_dir


def write_series(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    order: str,
    by_date: bool = True,
    mode: str = "overwrite",
) -> None:
    """A Parquet table sorted by key and time, in one folder per day so that readers prune days.

    The shuffle is by range over (day, key, time): a long history is spread over several files.
    """
    position = [*keys, order]
    if by_date:
        df = df.withColumn("event_date", F.to_date(order))
        position = ["event_date", *position]
    writer = df.repartitionByRange(*position).sortWithinPartitions(*position).write.mode(mode)
    (writer.partitionBy("event_date") if by_date else writer).parquet(path)


def feature_json(properties: Column, geometry_type: str, coordinates: Column) -> Column:
    """One GeoJSON feature as text."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            properties.alias("properties"),
            F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        )
    )


def write_geojson_lines(features: DataFrame, path: str, column: str = "feature", mode: str = "overwrite") -> None:
    """Newline-delimited features, written in parallel."""
    features.select(F.col(column).alias("value")).write.mode(mode).text(path)


def feature_collections(features: DataFrame, column: str = "feature", by: Sequence[str] = ()) -> DataFrame:
    """Features as FeatureCollection documents: one for each value of the ``by`` columns, or one of all.

    A document is one row, assembled in one task, so ``by`` names columns that bound it. Without them all features
    become a single row, which only a small table allows; ``write_geojson_lines`` writes all of a large one.
    """
    keys = [F.col(b) for b in by] or [F.lit(0).alias("part")]
    joined = F.array_join(F.array_sort(F.collect_list(column)), ",")
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("features"),
        F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"),
    )


OPENING, CLOSING = '{"type":"FeatureCollection","features":[', "]}"


def write_collection(features: DataFrame, path: str, order: Sequence[str], column: str = "feature") -> None:
    """One FeatureCollection of any size as part files, which joined in the order of their names are one document.

    A line is one feature in the order of the ``order`` columns; the first line opens the document, every other one
    begins with a comma, and the last one closes it. No task holds more than its lines.
    """
    spark, folder = features.sparkSession, work_dir(features.sparkSession, "collection")
    ranged = features.repartitionByRange(*order, column).sortWithinPartitions(*order, column)
    # Numbers rise with the partition and within it, so they are the places of the whole order.
    ranged.select(F.col(column).alias("line"), F.monotonically_increasing_id().alias("place")).write.parquet(folder)
    placed = spark.read.parquet(folder)
    ends = placed.agg(F.struct(F.min("place").alias("first"), F.max("place").alias("last"))).scalar()
    marked = placed.withColumn("ends", ends)
    before = F.when(F.col("place") == F.col("ends.first"), F.lit(OPENING)).otherwise(F.lit(","))
    after = F.when(F.col("place") == F.col("ends.last"), F.lit(CLOSING)).otherwise(F.lit(""))
    lines = marked.select(F.concat(before, "line", after).alias("value"), "place")
    if placed.isEmpty():
        lines = spark.range(1).select(F.lit(OPENING + CLOSING).alias("value"), F.col("id").alias("place"))
    lines.repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)


def collection_lines(spark: SparkSession, path: str) -> DataFrame:
    """The features of a collection written by ``write_collection``, one a row."""
    line = F.col("value")
    line = F.when(line.startswith(OPENING), F.substring(line, len(OPENING) + 1, 2**31 - 1)).otherwise(F.substring(line, 2, 2**31 - 1))
    opened = spark.read.text(path).select(line.alias("line"))
    closed = opened.select(F.when(F.col("line").endswith(CLOSING), F.expr(f"left(line, length(line) - {len(CLOSING)})")).otherwise(F.col("line")).alias("feature"))
    return closed.where("feature <> ''")
