"""The live feeds: landing folder to rows, alerts, scored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from signalbox.functions.calendar import add_calendar, civil_timestamp
from signalbox.operators.serving import alerts
from signalbox.sources.snapshots import FILE, flatten_rail_json, flatten_road_xml, stream_landing
from signalbox.streaming.state import LatestState, run_batches

# How often the feeds are refreshed.
ROAD_EVERY = "5 minutes"
RAIL_EVERY = "15 seconds"


def road_rows(
    spark: SparkSession, landing: str, files_per_trigger: int | None = None, pattern: str = "*.xml"
) -> DataFrame:
    docs = stream_landing(spark, landing, pattern, files_per_trigger)
    rows = flatten_road_xml(docs, keep=[FILE]).rows.withColumn("datetime", civil_timestamp("date", "time"))
    return add_calendar(rows, "datetime")


def landed_road(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
    pattern: str = "*.xml",
    on_error: str = "row",
    every: str = ROAD_EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Road documents as they land: their rows to ``root``/rows and what was refused, with the reason, to ``root``/refused.

    Both sinks are keyed by batch and overwritten if a batch is run again, so every document is in them once.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        flat = flatten_road_xml(batch, on_error=on_error, keep=[FILE])
        rows = add_calendar(flat.rows.withColumn("datetime", civil_timestamp("date", "time")), "datetime")
        for name, part in (("rows", rows), ("refused", flat.rejected.select(FILE, "reason", "entry"))):
            part.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    docs = stream_landing(spark, landing, pattern, files_per_trigger)
    return run_batches(docs, process, checkpoint, every, available_now)


def rail_rows(
    spark: SparkSession,
    landing: str,
    files_per_trigger: int | None = None,
    missing: str = "zero",
    pattern: str = "*.json",
) -> DataFrame:
    docs = stream_landing(spark, landing, pattern, files_per_trigger)
    rows = flatten_rail_json(docs, missing=missing, keep_empty=False, keep=[FILE]).rows
    return add_calendar(rows, "timestamp")


def alert_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Delayed stations as they arrive, to a table of alerts."""
    writer = alerts(rows).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=RAIL_EVERY)
    return writer.start()


def scored_state(
    rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    state: LatestState,
    checkpoint: str,
    every: str = RAIL_EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Scores each micro-batch (``score`` keeps one row per key) and updates the latest state."""

    def process(batch: DataFrame, batch_id: int) -> None:
        state.process(score(batch), batch_id)

    return run_batches(rows, process, checkpoint, every, available_now)
