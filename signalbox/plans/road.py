"""The road feed end to end."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.calendar import add_calendar, civil_timestamp
from signalbox.functions.geometry import SIMPLIFY_TOLERANCE, TransverseMercator, reproject, simplify
from signalbox.operators.learn import road_samples, score_road, select_best
from signalbox.operators.network import keep_known
from signalbox.operators.series import gap_minutes, lead_label, run_minutes
from signalbox.operators.split import Split, gathered, plan_split
from signalbox.session import work_dir
from signalbox.sources.sinks import feature_json, write_series
from signalbox.sources.snapshots import FILE, flatten_road_xml, read_archive
from signalbox.sources.tables import read_table

# Fixed value: below this speed (km/h) a segment is congested.
CONGESTED_BELOW = 30


def congestion_features(
    df: DataFrame,
    tie: str,
    key: str = "segment_id",
    order: str = "datetime",
    speed: str = "speed",
    mode: str = "run",
    min_minutes: float | None = None,
    max_gap: float | None = None,
    split: Split | None = None,
) -> DataFrame:
    """Gap, congestion flag, run, minutes and label of every observation: one shuffle on the key."""
    keys = [key]
    split = split or plan_split(df, keys, order, tie)
    df = df.withColumn("is_congested", F.coalesce(F.col(speed) < CONGESTED_BELOW, F.lit(False)).cast("int"))
    df = gap_minutes(split.spread(df), keys, order, tie, max_gap=max_gap, split=split)
    df = run_minutes(df, keys, order, tie, "is_congested", mode=mode, min_minutes=min_minutes, split=split)
    return gathered(lead_label(df, keys, order, tie, "congestion_minutes", split=split))


def observations(docs: DataFrame, on_error: str = "row") -> DataFrame:
    """Documents to observations with calendar features."""
    rows = flatten_road_xml(docs, on_error=on_error, keep=[FILE]).rows
    return add_calendar(rows.withColumn("datetime", civil_timestamp("date", "time")), "datetime")


def prepare_training_table(spark: SparkSession, archive: str, output: str, **options) -> None:
    """Archive of XML snapshots to the Parquet training table.

    The observations are written first: parsing is the dear part, and measuring, cutting and the
    features each read them.
    """
    parsed = work_dir(spark, "road-observations")
    observations(read_archive(spark, archive, "*.xml")).write.parquet(parsed)
    rows = read_table(spark, parsed)
    write_series(congestion_features(rows, FILE, **options), output, ["segment_id"], "datetime")


def train(spark: SparkSession, table: str, seed: int, **options) -> Model:
    columns = ["segment_id", "datetime", FILE, "speed", "hour", "day_of_week", "is_weekend", "is_peak"]
    series = read_table(spark, table, [*columns, "label_congestion_minutes"])
    return select_best(road_samples(series, FILE), "label", seed, "regression", "datetime", **options)


def refresh(docs: DataFrame, model: Model) -> DataFrame:
    """One live refresh: newest documents to road state."""
    return score_road(observations(docs), model, FILE)


def road_features(
    centrelines: DataFrame, observed: DataFrame, grid: TransverseMercator | None, tolerance: float = SIMPLIFY_TOLERANCE
) -> DataFrame:
    """Observed roads with geometry in degrees, simplified: segment_id, STREET_ENAME, geometry, feature."""
    roads = keep_known(centrelines, observed, "ROUTE_ID", "segment_id")
    roads = roads.select(F.col("ROUTE_ID").alias("segment_id"), "STREET_ENAME", "geometry")
    if grid is not None:
        roads = roads.withColumn("geometry", reproject(F.col("geometry"), grid))
    roads = roads.withColumn("geometry", simplify(F.col("geometry"), tolerance))
    properties = F.struct("segment_id", "STREET_ENAME")
    return roads.withColumn("feature", feature_json(properties, "LineString", F.col("geometry")))
