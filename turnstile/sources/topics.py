"""Topic streams and payload decoding."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.times import PLAUSIBLE, event_time, hour_string, plausible
from turnstile.operators.curate import expand_struct, split_rows
from turnstile.sources.json_schema import required_fields

CORRUPT = "_corrupt_record"


def kafka_stream(
    spark: SparkSession, topic: str, bootstrap: str | None = None, offsets: str | None = None, max_offsets: int | None = None
) -> DataFrame:
    """A Kafka topic; needs the Spark Kafka connector on the class path.

    ``max_offsets`` bounds a micro-batch, e.g. when a long backlog is read.
    """
    reader = spark.readStream.format("kafka")
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return (
        reader
        .option("kafka.bootstrap.servers", bootstrap or os.getenv("KAFKA_BROKER", "localhost:9092"))
        .option("subscribe", topic)
        .option("startingOffsets", offsets or os.getenv("KAFKA_OFFSETS", "latest"))
        .option("failOnDataLoss", "false")
        .load()
        .select("value", "timestamp")
    )


def file_stream(spark: SparkSession, path: str, *, max_files: int | None = None, format: str = "parquet") -> DataFrame:
    """Landed messages as files: Parquet (value, timestamp), or text lines."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if format == "text":
        # A line has no time of its own; that of its file is the nearest.
        return reader.text(path).select("value", F.col("_metadata.file_modification_time").alias("timestamp"))
    return reader.schema("value string, timestamp timestamp").format(format).load(path)


def decode(
    messages: DataFrame, schema: T.StructType, epoch: str | None = "timestamp", bounds: tuple[int, int] = PLAUSIBLE
) -> DataFrame:
    """Parse ``value`` into ``payload`` and name what is wrong in ``reason``.

    ``from_json`` alone gives a struct of nulls for text that is no JSON, and
    drops a field of the wrong type without a word. The corrupt-record field
    and the required fields catch both; ``reason`` is null for good rows. A stamp
    in the field ``epoch`` that is outside ``bounds`` (epoch seconds) is a fault.
    """
    target = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).add(CORRUPT, T.StringType())
    parsed = messages.select(
        F.col("timestamp").alias("kafka_ts"),
        F.col("value").cast("string").alias("raw_value"),
    ).withColumn(
        "payload",
        F.from_json("raw_value", target, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}),
    )
    some_field = F.lit(False)
    for f in schema.fields:
        some_field = some_field | F.col("payload")[f.name].isNotNull()
    reason = (
        F.when(F.trim(F.coalesce("raw_value", F.lit(""))) == "", "empty")
        .when(F.col("payload").isNull(), "malformed")
        .when(F.col("payload")[CORRUPT].isNotNull(), F.when(some_field, "type").otherwise("malformed"))
    )
    for name in required_fields(schema):
        reason = reason.when(F.col("payload")[name].isNull(), f"missing {name}")
    if epoch in schema.names:
        reason = reason.when(~plausible(F.col("payload")[epoch], bounds), "timestamp")
    return parsed.withColumn("reason", reason)


def bronze_rows(decoded: DataFrame, epoch: str | None = "timestamp") -> DataFrame:
    """Good rows: payload columns, broker time, event time, date and hour."""
    rows = expand_struct(decoded, "payload", ["kafka_ts"]).drop(CORRUPT)
    seconds = F.col(epoch) if epoch in rows.columns else F.lit(None).cast("long")
    return (
        rows.withColumn("event_ts", event_time(seconds, F.col("kafka_ts")))
        .withColumn("ingest_ts", F.current_timestamp())
        .withColumn("date", F.to_date("event_ts"))
        .withColumn("hour", hour_string(F.col("event_ts")))
    )


def dead_letters(decoded: DataFrame, topic: str) -> DataFrame:
    """Bad rows as received, with the reason."""
    return decoded.select("raw_value", "kafka_ts", F.lit(topic).alias("topic"), F.current_timestamp().alias("ingest_ts"), "reason")


def split_messages(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rows(decoded, F.col("reason").isNull())
