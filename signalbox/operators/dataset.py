"""Training set preparation: scaling, splitting, and augmentation that can be repeated exactly."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Divisors of the raw features.
SPEED_SCALE = 100.0
ARRIVAL_SCALE = 60.0
# Copies per rare event, the spread of their noise, and the lower bounds that are kept.
COPIES = 5
NOISE = {"up_ttnt_1": 2.0, "down_ttnt_1": 2.0, "delay_duration_minutes": 1.0}
FLOORS = {"up_ttnt_1": 0.0, "down_ttnt_1": 0.0, "delay_duration_minutes": 1.0}

# Slices of time whose rows are counted in one pass.
SLICES = 4096
_DIGITS = 13  # hexadecimal digits that fit a double exactly


def scale(df: DataFrame, divisors: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(d)) for c, d in divisors.items()})


def uniform(keys: Sequence[str], *salt: Column | str) -> Column:
    """A number in (0, 1) that depends only on the row's key and the salt.

    Unlike ``rand(seed)`` it survives repartitioning and re-run tasks, and other engines can repeat it.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    parts += [s.cast("string") if isinstance(s, Column) else F.lit(s) for s in salt]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(16**_DIGITS))


def normal(keys: Sequence[str], *salt: Column | str) -> Column:
    """A standard normal number per row (Box-Muller)."""
    radius = F.sqrt(F.log(uniform(keys, *salt, "a")) * -2.0)
    return radius * F.cos(uniform(keys, *salt, "b") * F.lit(2 * math.pi))


def augment(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    copies: int = COPIES,
    noise: Mapping[str, float] = NOISE,
    floors: Mapping[str, float] = FLOORS,
) -> DataFrame:
    """The rows themselves (copy 0, unchanged) and ``copies`` noisy ones, clipped from below."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    noisy = {}
    for column, spread in noise.items():
        moved = F.col(column) + normal(keys, F.col("copy"), column, str(seed)) * F.lit(float(spread))
        if column in floors:
            moved = F.greatest(F.lit(float(floors[column])), moved)
        noisy[column] = F.when(F.col("copy") == 0, F.col(column)).otherwise(moved)
    return out.withColumns(noisy)


def split_stable(df: DataFrame, keys: Sequence[str], seed: int, train: float = 0.8) -> DataFrame:
    """Adds ``is_train``: a repeatable random split by row key."""
    return df.withColumn("is_train", uniform(keys, str(seed)) < F.lit(float(train)))


def split_random(df: DataFrame, seed: int, train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    return tuple(df.randomSplit([train, 1 - train], seed))


def split_by_time(df: DataFrame, order: str, train: float = 0.8) -> DataFrame:
    """Adds ``is_train``: everything up to the ``train`` quantile of time, so windows cannot leak.

    The cut is exact: the first time up to which there are ``train`` of all rows. Each pass counts rows in SLICES
    equal slices of the stretch of time that still holds it, and only these counts reach the driver.
    """
    at = F.unix_micros(F.col(order).cast("timestamp"))
    times = df.select(at.alias("t")).where("t is not null")
    rows, low, high = times.agg(F.count("t"), F.min("t"), F.max("t")).first()
    rank, before = max(1, math.ceil(round(train * rows, 6))), 0
    while rows and low < high:
        width = (high - low) // SLICES + 1
        inside = times.where(F.col("t").between(low, high)).select(F.expr(f"(t - {low}) div {width}").alias("slice"))
        for number, count in inside.groupBy("slice").count().orderBy("slice").collect():
            if before + count >= rank:
                low = low + number * width
                high = min(high, low + width - 1)
                break
            before += count
    return df.withColumn("is_train", at <= F.lit(high))


def sequence_vector(df: DataFrame, features: Sequence[str], column: str = "features") -> DataFrame:
    """Flattens a sequence of feature structs into one ML vector, oldest row first."""
    rows = F.transform(column, lambda r: F.array(*[r[f].cast("double") for f in features]))
    return df.withColumn(column, array_to_vector(F.flatten(rows)))


def loss_metrics(df: DataFrame, target: str, prediction: str, eps: float = 1e-12) -> DataFrame:
    """Mean squared error, and binary cross-entropy of the prediction as a probability."""
    p = F.least(F.greatest(F.col(prediction), F.lit(eps)), F.lit(1 - eps))
    y = F.col(target).cast("double")
    error = F.col(prediction) - y
    return df.agg(
        F.avg(error * error).alias("mse"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"),
        F.count(F.lit(1)).alias("n"),
    )
