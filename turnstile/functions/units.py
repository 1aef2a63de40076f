"""Weather units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: metres per second in one mile per hour.
MPH_TO_MPS = 0.44704


def to_celsius(temperature: Column, unit: Column) -> Column:
    """Fahrenheit by unit "F" in any case; no unit, or another, means Celsius."""
    degrees = temperature.cast("double")
    return F.when(F.upper(unit) == "F", (degrees - 32.0) * 5.0 / 9.0).otherwise(degrees)


def wind_speed_mps(text: Column) -> Column:
    """First number of "5 mph" or "5 to 10 mph" in m/s; null if it is none."""
    return F.get(F.split(text, " "), F.lit(0)).try_cast("double") * F.lit(MPH_TO_MPS)
