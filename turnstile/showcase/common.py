"""Registry of queries and the stand-in tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions.times import epoch_seconds, minute_of
from turnstile.operators.silver import crowding_score, keyed_means
from turnstile.session import use_utc
from turnstile.sources.tables import read_naive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its SQL twin."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_naive(use_utc(spark), f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def cents(column: str = "value"):
    """Money-like values as whole cents, so that sums are exact."""
    return F.round(F.col(column) * 100.0).cast("long")


def seconds(column: str = "ts"):
    return epoch_seconds(F.col(column))


def minute_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a minute series per type: the stand-in for Silver."""
    facts = keyed_means(
        events(spark, folder),
        ["event_type", minute_of(F.col("ts")).alias("minute")],
        "user_id",
        {"value": "avg_value"},
        "active_users",
        digits=2,
    )
    return facts.withColumn("score", crowding_score(F.col("avg_value"), F.col("active_users")))


MINUTES = """
minutes AS (
  SELECT event_type, date_trunc('minute', ts) AS minute, count(DISTINCT user_id) AS active_users,
         CAST(sum(CAST(round(value * 1e2) AS BIGINT)) AS DOUBLE) / count(value) / 1e2 AS avg_value
  FROM events GROUP BY 1, 2),
scored AS (
  SELECT *, CAST(floor(epoch(minute)) AS BIGINT) AS minute_s,
         coalesce(avg_value, 0) + active_users * 1e-1 AS score
  FROM minutes)
"""
