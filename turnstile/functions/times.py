"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def epoch_seconds(ts: Column) -> Column:
    return ts.cast("long")


def hour_string(ts: Column) -> Column:
    """Two-digit hour, the name of the ``hour`` partition."""
    return F.date_format(ts, "HH")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def version_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


# Epoch seconds that can be event times: up to the year 2100, so that stamps in
# milliseconds and overflowing ones are told apart.
PLAUSIBLE = (0, 4_102_444_800)


def plausible(epoch: Column, bounds: tuple[int, int] = PLAUSIBLE) -> Column:
    return epoch.between(*[F.lit(b).cast("long") for b in bounds])


def event_time(epoch: Column, fallback: Column, bounds: tuple[int, int] = PLAUSIBLE) -> Column:
    """Event time from epoch seconds in the bounds, else the broker's time."""
    return F.coalesce(F.when(plausible(epoch, bounds), F.timestamp_seconds(epoch)), fallback)

