"""Severity tiers and the map styles that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbox.functions.rounding import percent_text

# Inclusive upper bounds in minutes of the road tiers; exclusive lower bounds of the rail tiers.
ROAD_THRESHOLDS = (0, 5, 20)
RISK_THRESHOLDS = (0.3, 0.7)
# Tier -> (colour, line weight, opacity) of a road.
ROAD_STYLES = {
    "green": ("#28a745", 3, 0.8),
    "yellow": ("#ffc107", 4, 0.9),
    "orange": ("#fd7e14", 5, 1.0),
    "red": ("#dc3545", 6, 1.0),
    "grey": ("#6c757d", 2, 0.6),
}
# Tier -> (fill colour, radius, blinking) of a station marker.
MARKER_STYLES = {
    "green": ("#28a745", 6, False),
    "yellow": ("#ffc107", 7, False),
    "red": ("#dc3545", 8, True),
}
ACTIVE_TIERS = ("red", "yellow")


def road_severity(minutes: Column, thresholds: Sequence[float] = ROAD_THRESHOLDS) -> Column:
    green, yellow, orange = thresholds
    return (
        F.when(minutes.isNull(), "grey")
        .when(minutes <= green, "green")
        .when(minutes <= yellow, "yellow")
        .when(minutes <= orange, "orange")
        .otherwise("red")
    )


def rail_severity(risk: Column, thresholds: Sequence[float] = RISK_THRESHOLDS) -> Column:
    yellow, red = thresholds
    return F.when(risk > red, "red").when(risk > yellow, "yellow").otherwise("green")


def _style(tier: Column, styles: dict, i: int) -> Column:
    chosen = F
    for name, style in styles.items():
        chosen = chosen.when(tier == name, F.lit(style[i]))
    return chosen


def road_style(tier: Column) -> dict[str, Column]:
    return {n: _style(tier, ROAD_STYLES, i) for i, n in enumerate(("color", "weight", "opacity"))}


def marker_style(tier: Column) -> dict[str, Column]:
    """Stations without a forecast look like calm ones."""
    tier = F.coalesce(tier, F.lit("green"))
    return {n: _style(tier, MARKER_STYLES, i) for i, n in enumerate(("fill_color", "radius", "blinking"))}


def event_text(risk: Column, duration: Column, affected: Column) -> Column:
    return F.concat(
        F.lit("Risk: "),
        percent_text(risk),
        F.lit(" | Est. "),
        number_text(duration),
        F.lit("m | Affects ~"),
        affected.cast("string"),
        F.lit(" trains"),
    )


def number_text(x: Column) -> Column:
    """A double the way a browser prints it: whole numbers without a fraction."""
    x = x.cast("double")
    whole = (x == F.floor(x).cast("double")) & (F.abs(x) < F.lit(1e15))
    return F.when(whole, F.floor(x).cast("string")).otherwise(x.cast("string"))
