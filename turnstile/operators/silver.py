"""Minute facts per stop pair and cell (A1, A2, B1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions.cells import spatial_cell
from turnstile.functions.times import minute_of
from turnstile.operators.curate import cast_numbers, fill_unknown
from turnstile.operators.features import latest_per_key
from turnstile.operators.joins import hourly_means, join_hourly, next_in_sequence, parent_or_self


def crowding_score(mean_delay: Column, active: Column) -> Column:
    return F.coalesce(mean_delay, F.lit(0.0)) + active * 0.1


def exact_mean(value: Column, digits: int = 2) -> Column:
    """Mean of fixed-point values from an exact integer sum, so that the order
    of addition cannot change the last bit."""
    scale = 10.0**digits
    return F.sum(F.round(value * scale).cast("long")).cast("double") / F.count(value) / scale


def keyed_means(
    df: DataFrame,
    keys: Sequence[str | Column],
    distinct: str,
    means: dict[str, str],
    active: str = "active_trips",
    digits: int | None = None,
) -> DataFrame:
    """Distinct count of one column and the mean of others (``{column: output}``).

    With ``digits`` the means come from exact sums of fixed-point values.
    """

    def mean(column: str) -> Column:
        return F.avg(column) if digits is None else exact_mean(F.col(column), digits)

    return df.groupBy(*keys).agg(
        F.countDistinct(distinct).alias(active),
        *[mean(column).alias(output) for column, output in means.items()],
    )


def stop_pairs(stop_times: DataFrame) -> DataFrame:
    """(trip, stop, next stop) of the schedule, in numeric stop order."""
    timed = cast_numbers(stop_times.select("trip_id", "stop_id", "stop_sequence"), ["stop_sequence"], "long")
    paired = next_in_sequence(timed, ["trip_id"], ["stop_sequence", "stop_id"], "stop_id", "dest_stop")
    return paired.select("trip_id", "stop_id", "dest_stop")


def named_trip() -> Column:
    return F.coalesce("trip_id", F.lit("")) != ""


def update_totals(updates: DataFrame, pairs: DataFrame, stops: DataFrame) -> DataFrame:
    """Delay sums and counts per (trip, origin, dest), station by station.

    Updates without a trip (null or blank) meet no position and are left out. Null origin or destination becomes "unknown".
    """
    paired = (
        cast_numbers(
            updates.filter(named_trip()).select("trip_id", "stop_id", "arrival_delay_s", "departure_delay_s"),
            ["arrival_delay_s", "departure_delay_s"],
        )
        .join(pairs, on=["trip_id", "stop_id"], how="left")
        .withColumnRenamed("stop_id", "origin_stop")
    )
    placed = parent_or_self(parent_or_self(paired, "origin_stop", stops), "dest_stop", stops)
    return (
        fill_unknown(placed, ["origin_stop", "dest_stop"])
        .groupBy("trip_id", "origin_stop", "dest_stop")
        .agg(
            F.sum("arrival_delay_s").alias("arrival_sum"),
            F.count("arrival_delay_s").alias("arrival_n"),
            F.sum("departure_delay_s").alias("departure_sum"),
            F.count("departure_delay_s").alias("departure_n"),
        )
    )


def silver_facts(
    positions: DataFrame,
    updates: DataFrame,
    weather: DataFrame,
    stop_times: DataFrame,
    stops: DataFrame,
    *,
    resolution: int = 8,
    backend: str = "hex",
    dedupe: str | None = None,
) -> DataFrame:
    """Facts per (origin, dest, cell, minute).

    Each position meets every update of its trip, over all time, as in the
    plain join of the tables; ``dedupe="latest"`` keeps one update per trip and
    stop. Both sides are added up *before* they meet, and the averages are
    weighted by the counts, so a trip with P positions and U updates costs its
    distinct (cell, minute) times its distinct stop pairs, not P x U rows.
    All rows of a group share one hour, so the weather joins last, on one row
    per group. A blank trip id is no trip: feeds write it for an absent one, and
    all such rows would meet each other.
    """
    if dedupe == "latest":
        payload = ["arrival_delay_s", "departure_delay_s"]
        updates = latest_per_key(updates, ["trip_id", "stop_id"], ["event_ts", *payload], payload)
    elif dedupe is not None:
        raise ValueError(f"unknown dedupe mode: {dedupe}")
    seen = (
        positions.select(
            F.when(named_trip(), F.col("trip_id")).alias("trip_id"),
            spatial_cell(F.col("lat").cast("double"), F.col("lon").cast("double"), resolution, backend).alias("h3"),
            minute_of(F.col("event_ts")).alias("minute"),
        )
        .groupBy("trip_id", "h3", "minute")
        .agg(F.count("*").alias("seen"))
    )
    met = seen.join(update_totals(updates, stop_pairs(stop_times), stops), on="trip_id", how="left")
    met = fill_unknown(met, ["origin_stop", "dest_stop"])

    def weighted(total: str, count: str) -> Column:
        rows = F.sum(F.col("seen") * F.col(count))
        return F.sum(F.col("seen") * F.col(total)) / F.nullif(rows, F.lit(0).cast("long"))

    # (trip, cell, minute, origin, dest) is unique here, so a plain count of
    # non-null trips is the distinct count.
    facts = met.groupBy("origin_stop", "dest_stop", "h3", "minute").agg(
        F.count("trip_id").alias("active_trips"),
        weighted("arrival_sum", "arrival_n").alias("avg_arrival_delay_s"),
        weighted("departure_sum", "departure_n").alias("avg_departure_delay_s"),
    )
    readings = {"temp_c": "avg_temp_c", "wind_mps": "avg_wind_speed", "precip_mm": "avg_precip_mm"}
    return (
        join_hourly(facts, hourly_means(weather, "event_ts", readings), "minute")
        .drop("weather_hour")
        .withColumn("crowding_score", crowding_score(F.col("avg_arrival_delay_s"), F.col("active_trips")))
        .withColumn("date", F.to_date("minute"))
    )
