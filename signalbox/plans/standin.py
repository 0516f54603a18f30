"""Views that read the given tables as road and rail series, documents and network dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.operators import serving
from signalbox.session import pin_utc
from signalbox.sources import snapshots, tables


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return tables.read_table(pin_utc(spark), f"{sf}/{name}.parquet", columns or None)


def road(spark, sf) -> DataFrame:
    """Users as segments, values as speeds."""
    return table(spark, sf, "events", "event_id", "user_id", "ts", "value").select(
        "event_id", F.col("user_id").alias("segment_id"), F.col("ts").alias("datetime"), F.col("value").alias("speed")
    )


def _line() -> Column:
    return F.concat(F.lit("L"), (F.col("user_id") % 10).cast("string"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def rail(spark, sf) -> DataFrame:
    """Users as stations; errors are delays; views have no UP arrival."""
    events = table(spark, sf, "events")
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        _line().alias("line"),
        F.col("user_id").cast("string").alias("sta"),
        (F.col("event_type") == "error").cast("int").alias("isdelay"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("up_ttnt_1"),
        _k().alias("down_ttnt_1"),
    )


# ---- documents -------------------------------------------------------------------------------


def road_documents(spark, sf) -> DataFrame:
    """One XML document per hour. Errors are invalid readings; signups above 100 have an unreadable speed."""
    events = table(spark, sf, "events", "ts", "user_id", "event_type", "value")
    speed = F.when((F.col("event_type") == "signup") & (F.col("value") > 100), "fast").otherwise(
        F.col("value").cast("string")
    )
    rows = events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:00:00").alias("time"),
        F.col("user_id").alias("segment_id"),
        speed.alias("speed"),
        F.when(F.col("event_type") == "error", "N").otherwise("Y").alias("valid"),
    )
    return snapshots.nest_road_xml(rows, "date", "time", "segment_id", "speed", "valid")


def rail_documents(spark, sf) -> DataFrame:
    """One JSON document per hour; every event is a station. Views have an empty UP board, signups an
    unreadable first arrival, purchases no boards at all."""
    events = table(spark, sf, "events")
    kind = F.col("event_type")
    up = F.when(kind == "signup", "soon").otherwise(F.col("value").cast("string"))
    train = lambda text: F.create_map(F.lit("ttnt"), text)
    board = F.struct(
        F.when(kind == "view", F.array().cast("array<map<string,string>>")).otherwise(F.array(train(up))).alias("UP"),
        F.array(train(F.get_json_object("props", "$.k"))).alias("DOWN"),
    )
    rows = events.select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        _line().alias("line"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("sta"),
        F.when(kind == "error", "Y").otherwise("N").alias("isdelay"),
        F.when(kind != "purchase", board).alias("board"),
    )
    name = F.concat_ws("-", "line", "sta")
    data = F.when(F.col("board").isNotNull(), F.create_map(name, F.col("board")))
    rows = rows.withColumn("payload", F.struct("isdelay", data.alias("data")))
    return snapshots.nest_rail_json(rows, "ts", "line", "sta", "payload")


# ---- states ----------------------------------------------------------------------------------


def road_state(spark, sf) -> DataFrame:
    """Newest value of each segment as its predicted minutes, shifted so that every tier occurs."""
    newest = serving.latest(road(spark, sf), ["segment_id"], "datetime", "event_id")
    return newest.select(
        "segment_id",
        (F.col("speed") - 10.0).alias("predicted_congestion_minutes"),
        F.col("datetime").alias("updated_at"),
    )


def rail_state(spark, sf) -> DataFrame:
    """Forecast from each station's newest row, risk from its newest delayed row (if it has one)."""
    rows = rail(spark, sf)
    keys = ["line", "sta"]
    forecast = serving.latest(rows, keys, "timestamp", "event_id").select(
        *keys,
        (F.col("down_ttnt_1") / 7.0 + 0.5).alias("duration"),
        (F.col("down_ttnt_1") / 8.0).alias("affected"),
        F.coalesce("up_ttnt_1", F.lit(0.0)).alias("up_ttnt_1"),
        "down_ttnt_1",
        F.col("timestamp").alias("updated_at"),
    )
    delayed = serving.latest(serving.alerts(rows), keys, "timestamp", "event_id")
    risks = delayed.select(*keys, F.least(F.lit(1.0), F.col("up_ttnt_1") / 60.0).alias("delay_risk_probability"))
    return serving.combine_forecasts(forecast, risks, keys)


# ---- geometry --------------------------------------------------------------------------------


def places(spark, sf) -> DataFrame:
    """Neighbouring embedding coordinates as places, all of a vector: vec_id, pos, x, y."""
    number = lambda i: F.get("embedding", i).cast("double")
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1),
        lambda i: F.struct(number(2 * i).alias("x"), number(2 * i + 1).alias("y")),
    )
    rows = table(spark, sf, "embeddings", "vec_id", "embedding")
    return rows.select("vec_id", F.posexplode(pairs).alias("pos", "p")).select("vec_id", "pos", "p.x", "p.y")


# Commands of a stand-in path and how many of a vector's 64 numbers each takes.
PATH = (("M", 2), ("L", 2), ("C", 6), ("M", 2), ("C", 6), ("C", 6), ("M", 2), *(("C", 6),) * 6, ("L", 2))


def path_texts(spark, sf) -> DataFrame:
    """A path per embedding: three subpaths of lines and curves through all of its numbers."""
    n = lambda i: F.get("embedding", F.lit(i)).cast("double").cast("string")
    pieces, at = [], 0
    for command, count in PATH:
        pieces += [F.lit(command), F.concat_ws(",", *[n(at + i) for i in range(count)])]
        at += count
    return table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.concat(*pieces).alias("path"))


def grid_lines(spark, sf) -> DataFrame:
    """Road centrelines in grid metres: a vertex for every two numbers of an embedding."""
    number = lambda i: F.get("embedding", i).cast("double") * 20000.0
    line = F.transform(
        F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1),
        lambda i: F.array(number(2 * i) + 836694.05 + i * 400.0, number(2 * i + 1) + 819069.80),
    )
    return table(spark, sf, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("ROUTE_ID"),
        F.concat(F.lit("Street "), F.col("label").cast("string")).alias("STREET_ENAME"),
        line.alias("geometry"),
    )
