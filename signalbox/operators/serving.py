"""The latest-state table and the queries a dashboard asks of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions import severity
from signalbox.functions.rounding import exact_round, non_negative, percent_text, round_count
from signalbox.operators.newest import is_fixed, packed, row_at


def latest(df: DataFrame, keys: Sequence[str], order: str, tie: str | Sequence[str] = ()) -> DataFrame:
    """Each key's newest row. A key with many rows is reduced before the shuffle, see ``newest``."""
    tie = [tie] if isinstance(tie, str) else list(tie)
    return row_at(df, keys, order, tie, df.columns).select(*df.columns)


def latest_filled(
    df: DataFrame, keys: Sequence[str], order: str, tie: str | Sequence[str], cols: Sequence[str], fill: float = 0.0
) -> DataFrame:
    """Each key's newest row as a forward fill would leave it: a null in ``cols`` takes the newest value before it.

    An aggregate, so nothing has to be filled but the rows that stay.
    """
    tie = [tie] if isinstance(tie, str) else list(tie)
    others = [c for c in df.columns if c not in (*keys, *cols)]
    at = packed(df, order, tie)
    if at is not None and all(is_fixed(df.schema[c].dataType) for c in (*others, *cols)):
        df = df.withColumn("__at", at)
        newest = [F.max_by(c, "__at").alias(c) for c in others]
        known = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))), F.lit(fill)).alias(c) for c in cols]
        return df.groupBy(*keys).agg(*newest, *known).select(*[c for c in df.columns if c != "__at"])
    place = F.struct(order, *tie)
    filled = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), place)), F.lit(fill)).alias(c) for c in cols]
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*others), place).alias("__row"), *filled)
    return rows.select(*keys, "__row.*", *cols).select(*df.columns)


def lookup(
    state: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    value: str | Sequence[str],
    digits: int | None = None,
    unknown: str = "Not found",
) -> DataFrame:
    """Requested keys with their value and a status; unknown keys stay, with a null value.

    ``value`` may name several columns: the whole forecast. ``digits`` rounds the floating-point ones. A key is
    known if any of its values is.
    """
    names = [value] if isinstance(value, str) else list(value)
    floating = {c for c, kind in state.dtypes if kind in ("double", "float")}
    shown = [F.col(v) if digits is None or len(names) > 1 and v not in floating else exact_round(F.col(v), digits) for v in names]
    known = state.select(*keys, *[c.alias(v) for c, v in zip(shown, names)])
    status = F.when(F.coalesce(*[F.col(v).cast("string") for v in names]).isNull(), unknown).otherwise("Success")
    return wanted.select(*keys).join(known, list(keys), "left").withColumn("status", status)


def lookup_where(state: DataFrame, **partial: object) -> DataFrame:
    """Rows that match every given key column; an omitted (None) one does not filter."""
    for column, value in partial.items():
        if value is not None:
            state = state.where(F.col(column) == F.lit(value))
    return state


def summary(state: DataFrame, updated: str = "updated_at") -> DataFrame:
    """How many keys there are and when the state last changed."""
    return state.agg(F.count(F.lit(1)).alias("count"), F.max(updated).alias("last_update"))


def predictions(state: DataFrame, keys: Sequence[str], value: str, digits: int) -> DataFrame:
    """Key text and rounded value, one row per key (a map of all keys would be one unbounded row)."""
    return state.select(
        F.concat_ws("-", *keys).alias("key"), exact_round(F.col(value), digits).alias(value)
    )


def combine_forecasts(
    events: DataFrame, risks: DataFrame, keys: Sequence[str] = ("line", "sta"), thresholds=severity.RISK_THRESHOLDS
) -> DataFrame:
    """Rail state rows: the event forecast with the station's risk (0.0 if it has none) and its tier.

    ``events`` has duration, affected, up_ttnt_1 and down_ttnt_1 per key; ``risks`` has
    delay_risk_probability.
    """
    joined = events.join(risks.select(*keys, "delay_risk_probability"), list(keys), "left")
    return rail_state(joined, keys, thresholds)


def rail_state(
    forecasts: DataFrame, keys: Sequence[str] = ("line", "sta"), thresholds=severity.RISK_THRESHOLDS
) -> DataFrame:
    """Rounds and classifies rows that hold a station's risk and its event forecast."""
    joined = forecasts
    risk = exact_round(F.coalesce("delay_risk_probability", F.lit(0.0)), 4)
    return joined.select(
        *keys,
        risk.alias("delay_risk_probability"),
        exact_round(non_negative(F.col("duration")), 1).alias("delay_duration_minutes"),
        round_count(non_negative(F.col("affected"))).alias("affected_trains_count"),
        severity.rail_severity(risk, thresholds).alias("color_code"),
        exact_round(F.col("up_ttnt_1"), 1).alias("up_ttnt"),
        exact_round(F.col("down_ttnt_1"), 1).alias("down_ttnt"),
        *[c for c in joined.columns if c == "updated_at"],
    )


def road_network(
    roads: DataFrame, state: DataFrame, road: str, value: str, thresholds=severity.ROAD_THRESHOLDS
) -> DataFrame:
    """Every road with its forecast, tier and style; roads without a forecast are grey."""
    joined = roads.join(state.select(road, value), road, "left")
    tier = severity.road_severity(F.col(value), thresholds)
    return joined.withColumn("tier", tier).withColumns(severity.road_style(F.col("tier")))


def rail_network(points: DataFrame, state: DataFrame, keys: Sequence[str] = ("line", "sta")) -> DataFrame:
    """Every station point with its forecast and marker style."""
    joined = points.join(state, list(keys), "left")
    return joined.withColumns(severity.marker_style(F.col("color_code")))


def _active(tier: Column) -> Column:
    return tier.isin(*severity.ACTIVE_TIERS)


def active_events(state: DataFrame, keys: Sequence[str] = ("line", "sta"), k: int | None = None) -> DataFrame:
    """Stations at risk, highest risk first, with the texts of the events panel; the top ``k`` if given."""
    risk = F.col("delay_risk_probability")
    ranked = (
        state.where(_active(F.col("color_code")))
        .withColumn("risk_text", percent_text(risk))
        .withColumn(
            "message",
            severity.event_text(risk, F.col("delay_duration_minutes"), F.col("affected_trains_count")),
        )
        .orderBy(risk.desc(), *keys)
    )
    return ranked if k is None else ranked.limit(k)


def active_count(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(_active(F.col("color_code"))).alias("active_stations"))


def locate_events(events: DataFrame, points: DataFrame, keys: Sequence[str] = ("line", "sta")) -> DataFrame:
    """Active events with the map point to zoom to."""
    return events.join(points, list(keys), "inner")


def alerts(rows: DataFrame) -> DataFrame:
    """Rows that report a delay; works on batches and on streams."""
    return rows.where("isdelay = 1")
