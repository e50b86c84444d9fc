"""Numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """A double rounded as C does: times a power of ten, to the nearest whole number, halves away from zero.

    Spark's own rounding goes by the decimal digits that a double prints as, so
    1.005, which is a little less, becomes 1.01 there and 1.0 here and in SQL
    engines. What the power takes out of range stays as it is.
    """
    power = F.lit(10.0**places)
    whole = F.round(value * power, 0)
    return F.when(F.abs(whole) == float("inf"), value).otherwise(whole / power)
