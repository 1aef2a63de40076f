"""Landed feed documents as message rows.

Input rows hold one JSON document each. Times that are absent or zero become
``now`` (epoch seconds, by default the query's time). What cannot be read in a
document does not stop its other rows; ``rejected`` names such documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions.units import to_celsius, wind_speed_mps
from turnstile.functions.values import blank_if_absent, stamp_or_now, zero_if_absent

VEHICLES = (
    "entity array<struct<vehicle:struct<vehicle:struct<id:string>,trip:struct<trip_id:string,route_id:string>,"
    "position:struct<latitude:double,longitude:double,speed:double>,timestamp:bigint>>>"
)
UPDATES = (
    "entity array<struct<trip_update:struct<trip:struct<trip_id:string>,timestamp:bigint,"
    "stop_time_update:array<struct<stop_id:string,arrival:struct<delay:bigint>,departure:struct<delay:bigint>>>>>>"
)
FORECAST = (
    "properties struct<units:string,periods:array<struct<temperature:double,temperatureUnit:string,"
    "windSpeed:string,shortForecast:string>>>"
)

CORRUPT = "_corrupt_record"


def _parsed(document: str, schema: str) -> Column:
    return F.from_json(document, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def rejected(feeds: DataFrame, schema: str, document: str = "value") -> DataFrame:
    """Documents that are not wholly readable, with the reason.

    "empty" and "malformed" ones give no rows; those of reason "type" hold a field
    of another type, which is null in the rows they give.
    """
    parsed = feeds.select(F.col(document).cast("string").alias("raw_value")).withColumn("__doc", _parsed("raw_value", schema))
    field = schema.split()[0]
    reason = (
        F.when(F.trim(F.coalesce("raw_value", F.lit(""))) == "", "empty")
        .when(F.col("__doc").isNull(), "malformed")
        .when(F.col("__doc")[CORRUPT].isNotNull(), F.when(F.col("__doc")[field].isNull(), "malformed").otherwise("type"))
    )
    return parsed.withColumn("reason", reason).filter("reason is not null").select("raw_value", "reason")


def vehicle_positions(feeds: DataFrame, document: str = "value", now: Column | None = None) -> DataFrame:
    """One row per entity that has a position; a coordinate that is absent or unreadable is null."""
    entity = feeds.select(F.explode(_parsed(document, VEHICLES)["entity"]).alias("e")).select("e.vehicle.*")
    return entity.filter(F.col("position").isNotNull()).select(
        blank_if_absent(F.col("vehicle.id")).alias("vehicle_id"),
        blank_if_absent(F.col("trip.trip_id")).alias("trip_id"),
        blank_if_absent(F.col("trip.route_id")).alias("route_id"),
        F.col("position.latitude").alias("lat"),
        F.col("position.longitude").alias("lon"),
        F.coalesce("position.speed", F.lit(0.0)).alias("speed_mps"),
        stamp_or_now(F.col("timestamp"), now).alias("timestamp"),
    )


def trip_updates(feeds: DataFrame, document: str = "value", now: Column | None = None) -> DataFrame:
    """One row per stop update; all updates of an entity share its time."""
    entity = feeds.select(F.explode(_parsed(document, UPDATES)["entity"]).alias("e")).select("e.trip_update.*")
    stops = entity.select("trip", "timestamp", F.explode("stop_time_update").alias("s"))
    return stops.select(
        blank_if_absent(F.col("trip.trip_id")).alias("trip_id"),
        blank_if_absent(F.col("s.stop_id")).alias("stop_id"),
        zero_if_absent(F.col("s.arrival.delay")).alias("arrival_delay_s"),
        zero_if_absent(F.col("s.departure.delay")).alias("departure_delay_s"),
        stamp_or_now(F.col("timestamp"), now).alias("timestamp"),
    )


def first_items(df: DataFrame, array: str, n: int | None, name: str) -> DataFrame:
    """One row per item of an array, or of its first ``n``."""
    return df.withColumn(name, F.explode(F.slice(array, 1, n) if n is not None else F.col(array)))


def weather_hourly(
    forecasts: DataFrame,
    document: str = "value",
    lat: Column | None = None,
    lon: Column | None = None,
    now: Column | None = None,
    periods: int | None = None,
) -> DataFrame:
    """One row per forecast period, in metric units; ``periods`` takes the first ones only (the original sends 12)."""
    parsed = forecasts.withColumn("__doc", _parsed(document, FORECAST)["properties"])
    parsed = parsed.withColumn("__periods", F.col("__doc.periods"))
    rows = first_items(parsed, "__periods", periods, "__p")
    return rows.select(
        F.coalesce("__doc.units", F.lit("NWS")).alias("station_id"),
        to_celsius(F.col("__p.temperature"), F.col("__p.temperatureUnit")).alias("temp_c"),
        wind_speed_mps(F.col("__p.windSpeed")).alias("wind_mps"),
        F.lit(None).cast("double").alias("precip_mm"),
        F.col("__p.shortForecast").alias("condition"),
        stamp_or_now(F.lit(None), now).alias("timestamp"),
        (F.lit(None) if lat is None else lat).cast("double").alias("lat"),
        (F.lit(None) if lon is None else lon).cast("double").alias("lon"),
    )
