"""The first or last row of every key, reduced before the shuffle without sorting where types allow.

An aggregate can be kept in a hash table only while its state has a fixed width, which a struct, as the order of
(time, tiebreaker) or as the row that is wanted, has not. So time and tiebreaker are packed into one decimal, and every
wanted column is taken by itself: all of them follow the same order, hence the same row. Rows with
columns of other types are aggregated as structs. Either way a task sends on one row of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_FIXED = (*_WHOLE, *_TIMES, T.FloatType, T.DoubleType, T.BooleanType, T.DecimalType)


def is_fixed(kind: T.DataType) -> bool:
    return isinstance(kind, _FIXED)


def _whole(df: DataFrame, name: str) -> Column | None:
    """An ordering column as a long, if it is one or a time."""
    kind = df.schema[name].dataType
    if isinstance(kind, _TIMES):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("bigint") if isinstance(kind, _WHOLE) else None


def packed(df: DataFrame, order: str, tie: Sequence[str]) -> Column | None:
    """(order, tie) as one number of fixed width in the same order, nulls first; None where the types don't allow it.

    Times have at most 18 digits, and a tiebreaker, counted up from the smallest long, has at most 20.
    """
    at = _whole(df, order) if len(tie) < 2 else None
    if at is None:
        return None
    if not tie:
        return F.coalesce(at, F.lit(-(1 << 63)))
    after = _whole(df, tie[0])
    if after is None or not isinstance(df.schema[order].dataType, _TIMES):
        return None
    wide = lambda c: c.cast("decimal(20,0)")
    rank = F.coalesce(wide(after) + F.lit(Decimal(2**63 + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    time = F.coalesce(at, F.lit(-(10**18) + 1)).cast("decimal(18,0)")
    return (time * F.lit(Decimal(10**20)).cast("decimal(21,0)")).cast("decimal(38,0)") + rank.cast("decimal(20,0)")


def row_at(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], cols: Sequence[str], last: bool = True) -> DataFrame:
    """keys and ``cols`` of each key's last (or first) row in the order of (order, tie); nulls come first."""
    keys, cols = list(keys), [c for c in cols if c not in keys]
    at = packed(df, order, tie)
    if at is not None and all(is_fixed(df.schema[c].dataType) for c in cols):
        take = F.max_by if last else F.min_by
        given = df.select(*keys, *cols, at.alias("__at"))
        if not cols:
            return given.select(*keys).distinct()
        return given.groupBy(*keys).agg(*[take(c, "__at").alias(c) for c in cols])
    # Any type can be ordered inside a struct; the row is one value, and its task sorts by key instead of hashing.
    place, take = F.struct(order, *tie), F.max_by if last else F.min_by
    found = df.groupBy(*keys).agg(take(F.struct(*cols), place).alias("__row"))
    return found.select(*keys, "__row.*")
