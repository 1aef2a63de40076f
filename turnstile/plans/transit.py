"""Names and contracts of the transit pipeline."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from turnstile.sources.json_schema import load_schema, struct_type

VEHICLES = "gtfs.vehicle_positions"
UPDATES = "gtfs.trip_updates"
WEATHER = "weather.hourly"

# The wire contract of each topic, as JSON Schema.
PAYLOADS = {
    VEHICLES: {
        "type": "object",
        "properties": {
            "vehicle_id": {"type": "string"},
            "route_id": {"type": "string"},
            "trip_id": {"type": "string"},
            "lat": {"type": "number"},
            "lon": {"type": "number"},
            "speed_mps": {"type": ["number", "null"]},
            "timestamp": {"type": "integer"},
        },
        "required": ["vehicle_id", "route_id", "trip_id", "lat", "lon", "timestamp"],
    },
    UPDATES: {
        "type": "object",
        "properties": {
            "trip_id": {"type": "string"},
            "stop_id": {"type": "string"},
            "arrival_delay_s": {"type": "integer"},
            "departure_delay_s": {"type": "integer"},
            "timestamp": {"type": "integer"},
        },
        "required": ["trip_id", "stop_id", "timestamp"],
    },
    WEATHER: {
        "type": "object",
        "properties": {
            "station_id": {"type": "string"},
            "temp_c": {"type": ["number", "null"]},
            "wind_mps": {"type": ["number", "null"]},
            "precip_mm": {"type": ["number", "null"]},
            "condition": {"type": ["string", "null"]},
            "timestamp": {"type": "integer"},
            "lat": {"type": ["number", "null"]},
            "lon": {"type": ["number", "null"]},
        },
        "required": ["timestamp"],
    },
}

SERIES = ("origin_stop", "dest_stop", "h3")
HORIZONS = (10, 20, 30)
QUANTILES = (0.5, 0.9)


def payload_schema(topic: str) -> T.StructType:
    if topic not in PAYLOADS:
        raise FileNotFoundError(f"no schema for topic {topic}")
    return struct_type(PAYLOADS[topic])


def contract(spark: SparkSession, topic: str, folder: str | None = None) -> T.StructType:
    """The payload of a topic by the schema file in ``folder``; without one, by the contracts above."""
    if folder is None:
        return payload_schema(topic)
    try:
        return load_schema(spark, topic, folder)
    except FileNotFoundError:
        if topic not in PAYLOADS:
            raise
        return payload_schema(topic)


def bronze_path(root: str, topic: str) -> str:
    return f"{root}/bronze/{topic}"


def schedule_root(root: str) -> str:
    return f"{root}/gtfs"


def silver_path(root: str) -> str:
    return f"{root}/silver"


def gold_path(root: str) -> str:
    return f"{root}/gold"


def gold_days_path(root: str) -> str:
    return f"{root}/gold_by_day"


def features_path(root: str) -> str:
    return f"{root}/online_features"


def expired_path(root: str) -> str:
    return f"{root}/expired_features"


def registry_path(root: str) -> str:
    return f"{root}/registry"


def reports_path(root: str) -> str:
    return f"{root}/reports"
