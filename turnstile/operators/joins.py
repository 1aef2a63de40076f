"""Equi-joins of events with schedules, weather and stops.

No side is broadcast by hint: Spark broadcasts a side whose size it knows to be
under ``spark.sql.autoBroadcastJoinThreshold``, and AQE splits skewed
partitions of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions.times import hour_of
from turnstile.functions.values import has_prefix
from turnstile.operators.slices import ROWS_PER_SLICE, sliced_window


def next_in_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    *,
    drop_last: bool = True,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Add the next row's ``value`` per key; by default without each last row.

    ``order`` should be total. Sequence numbers must be numeric: as text, "10"
    sorts before "2".
    """
    led = sliced_window(
        df, keys, order, near=lambda w: {name: F.lead(value, 1).over(w)}, after=1, rows_per_slice=rows_per_slice
    )
    return led.dropna(subset=[name]) if drop_last else led


def hourly_means(df: DataFrame, ts: str, values: dict[str, str], hour: str = "weather_hour") -> DataFrame:
    """One row per hour with the mean of each column (``{column: output}``).

    Several readings per hour would multiply the rows they are joined to.
    """
    return df.groupBy(hour_of(F.col(ts)).alias(hour)).agg(
        *[F.avg(column).alias(output) for column, output in values.items()]
    )


def join_hourly(df: DataFrame, hourly: DataFrame, ts: str, hour: str = "weather_hour") -> DataFrame:
    return df.withColumn(hour, hour_of(F.col(ts))).join(hourly, on=hour, how="left")


def join_role(df: DataFrame, dim: DataFrame, role: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Left join a dimension on ``role`` = its ``key``, under the role's names."""
    side = dim.select(F.col(key).alias(role), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(side, on=role, how="left")


def parent_or_self(df: DataFrame, stop: str, stops: DataFrame, key: str = "stop_id", parent: str = "parent_station") -> DataFrame:
    """Replace a stop by its parent station where it has one."""
    joined = join_role(df, stops, stop, key, {parent: "__parent"})
    return joined.withColumn(stop, F.coalesce("__parent", stop)).drop("__parent")


def named_stations(stops: DataFrame, prefix: str = "place-", key: str = "stop_id", label: str = "stop_name") -> DataFrame:
    """Stations only: ids that start with ``prefix``; a null id is none."""
    return stops.filter(has_prefix(F.col(key), prefix)).select(F.col(key).alias("stop_id"), F.col(label).alias("stop_name"))


def resolve_ids(df: DataFrame, column: str, names: DataFrame, key: str = "stop_id", label: str = "stop_name") -> DataFrame:
    """Turn an id or a name (any case) into the id; other text stays as it is.

    Several ids with one name give the greatest id.
    """
    ids = names.groupBy(F.col(key).alias(column)).agg(F.lit(True).alias("__is_id"))
    by_name = names.groupBy(F.lower(F.col(label)).alias("__name")).agg(F.max(key).alias("__id"))
    return (
        df.join(ids, on=column, how="left")
        .withColumn("__name", F.lower(F.col(column)))
        .join(by_name, on="__name", how="left")
        .withColumn(column, F.when(F.col("__is_id"), F.col(column)).otherwise(F.coalesce("__id", column)))
        .drop("__is_id", "__name", "__id")
    )


def add_names(df: DataFrame, column: str, output: str, names: DataFrame, key: str = "stop_id", label: str = "stop_name") -> DataFrame:
    """Add the name of an id; an unknown id is its own name."""
    side = names.groupBy(F.col(key).alias(column)).agg(F.max(label).alias("__label"))
    return df.join(side, on=column, how="left").withColumn(output, F.coalesce("__label", column)).drop("__label")


def name_to_id(df: DataFrame, column: str, output: str, names: DataFrame, key: str = "stop_id", label: str = "stop_name") -> DataFrame:
    """Add the id of a name in any case; null if there is none."""
    side = names.groupBy(F.lower(F.col(label)).alias("__name")).agg(F.max(key).alias(output))
    return df.withColumn("__name", F.lower(F.col(column))).join(side, on="__name", how="left").drop("__name")
