"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(x: Column, digits: int, ties: str = "even") -> Column:
    """Rounds to ``digits`` decimals by the number's exact value; true ties go to even, or up.

    ``bround`` looks at the shortest decimal text instead: it takes 0.35 for a tie although the stored
    number lies below it. Here ``x * 2 * 10^digits`` is formed together with its exact rounding error
    (Dekker's product), and the error decides when the product falls on a tie.
    """
    scale = float(10**digits)
    double = 2.0 * scale
    product = x * F.lit(double)
    upper = x * F.lit(134217729.0)
    high = upper - (upper - x)
    error = (high * F.lit(double) - product) + (x - high) * F.lit(double)
    below = F.floor(product / 2).cast("double")
    over = product - below * 2
    up = below + 1
    tie = F.when(below % 2 == 0, below).otherwise(up) if ties == "even" else up
    nearest = (
        F.when(over < 1, below)
        .when(over > 1, up)
        .when(error < 0, below)
        .when(error > 0, up)
        .otherwise(tie)
    )
    return F.when(F.abs(product) < F.lit(float(2**52)), nearest / F.lit(scale)).otherwise(x)


def round_count(x: Column) -> Column:
    """Nearest whole number (ties to even), never below zero."""
    return F.greatest(F.lit(0), exact_round(x, 0).cast("int"))


def non_negative(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def percent_text(share: Column) -> Column:
    """``0.1234`` as ``12.3%``; true ties round up."""
    return F.format_string("%.1f%%", exact_round(share.cast("double") * 100, 1, ties="up"))
