"""Civil-time scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The peak hours, both ends included (07:00-09:59 and 17:00-19:59).
PEAK_HOURS = ((7, 9), (17, 19))
# Fixed value: the capture stamp of a rail snapshot.
STAMP_FORMAT = "yyyyMMdd_HHmmss"
CLOCK_FORMAT = "yyyy-MM-dd HH:mm:ss"

MICROS_PER_MINUTE = 60_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def civil_timestamp(date: Column | str, time: Column | str) -> Column:
    """``date`` and ``time`` texts to a timestamp; unreadable text gives null."""
    return F.concat_ws(" ", _col(date), _col(time)).try_cast("timestamp")


def stamp_to_timestamp(stamp: Column | str) -> Column:
    """``yyyyMMdd_HHmmss`` to a timestamp; unreadable text gives null."""
    return F.try_to_timestamp(_col(stamp), F.lit(STAMP_FORMAT))


def timestamp_to_stamp(ts: Column | str) -> Column:
    return F.date_format(_col(ts), STAMP_FORMAT)


def timestamp_to_clock(ts: Column | str) -> Column:
    return F.date_format(_col(ts), CLOCK_FORMAT)


def micros(ts: Column | str) -> Column:
    """Exact microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_MINUTE))


def is_peak(hour: Column, peak=PEAK_HOURS) -> Column:
    inside = F.lit(False)
    for first, last in peak:
        inside = inside | hour.between(first, last)
    return inside.cast("int")


def add_calendar(df: DataFrame, ts: str, peak=PEAK_HOURS) -> DataFrame:
    """Adds hour, day_of_week (Monday = 0), is_weekend and is_peak (0/1)."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": weekday,
            "is_weekend": weekday.isin(5, 6).cast("int"),
            "is_peak": is_peak(hour, peak),
        }
    )
