"""Delay events: stretches of delayed rows with their duration and estimated impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.calendar import minutes_between
from signalbox.operators.series import change_blocks
from signalbox.operators.split import PIECE, Split

# The shortest duration an event gets, and the minutes per affected train.
MIN_EVENT_MINUTES = 1.0
MINUTES_PER_TRAIN = 5


def affected_trains(duration: Column, per_train: float = MINUTES_PER_TRAIN) -> Column:
    """One train plus one for every full ``per_train`` minutes."""
    return (F.lit(1) + F.floor(duration / F.lit(float(per_train)))).cast("int")


def extract_events(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    flag: str,
    features: Sequence[str],
    min_minutes: float = MIN_EVENT_MINUTES,
    per_train: float = MINUTES_PER_TRAIN,
    observed: str | None = None,
    max_gap: float | None = None,
    split: Split | None = None,
) -> DataFrame:
    """One row per unbroken stretch of flagged rows: start, features of its first row, duration, impact.

    ``observed`` names a column with the trains on the boards; its largest value within the event is
    then reported as ``observed_trains_count`` next to the estimate. ``max_gap`` also ends an event at a
    pause of more than that many minutes.
    The result also has ``block_id``, ``end_time`` and ``row_count``. Without flagged rows it is empty.
    """
    tie = [tie] if isinstance(tie, str) else list(tie)
    carried = [*keys, order, *tie, flag, *features]
    carried += [observed] if observed else []
    carried += [PIECE] if PIECE in df.columns else []
    blocks = change_blocks(
        df.select(*dict.fromkeys(carried)), keys, order, tie, flag, starts="__starts", max_gap=max_gap, split=split
    )
    # Exactly one row of a stretch starts it. Taking the features from that row needs no ordering, so
    # the aggregate is a hash aggregate, combined before the shuffle.
    aggregates = [
        F.min(order).alias("__start"),
        F.max(order).alias("end_time"),
        F.count(F.lit(1)).alias("row_count"),
        *[
            F.first(F.when(F.col("__starts"), F.col(f)), ignorenulls=True).alias(f"__f_{f}")
            for f in features
        ],
    ]
    if observed:
        aggregates.append(F.max(observed).alias("observed_trains_count"))
    events = blocks.where(F.col(flag) == 1).groupBy(*keys, "block_id").agg(*aggregates)
    duration = F.greatest(F.lit(float(min_minutes)), minutes_between("__start", "end_time"))
    return (
        events.withColumn("delay_duration_minutes", duration)
        .withColumn(
            "affected_trains_count", affected_trains(F.col("delay_duration_minutes"), per_train)
        )
        .select(
            *keys,
            F.col("__start").alias(order),
            *[F.col(f"__f_{f}").alias(f) for f in features],
            "delay_duration_minutes",
            "affected_trains_count",
            "block_id",
            "end_time",
            "row_count",
            *(["observed_trains_count"] if observed else []),
        )
    )


def event_count(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    flag: str,
    split: Split | None = None,
) -> DataFrame:
    """How many distinct events there are, counted on (keys, block)."""
    blocks = change_blocks(df, keys, order, tie, flag, split=split)
    return (
        blocks.where(F.col(flag) == 1)
        .select(*keys, "block_id")
        .distinct()
        .agg(F.count(F.lit(1)).alias("delay_events"))
    )


def profile(df: DataFrame, label: str) -> DataFrame:
    """Row count, sum of a label, and whether any row has it."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(label).alias("positive_samples"),
        F.coalesce(F.max(F.col(label) > 0), F.lit(False)).alias("has_positive"),
    )
