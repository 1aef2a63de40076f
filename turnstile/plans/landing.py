"""Feed documents to topic messages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnstile.plans import transit
from turnstile.sources import feeds

FEEDS = {
    transit.VEHICLES: (feeds.vehicle_positions, feeds.VEHICLES),
    transit.UPDATES: (feeds.trip_updates, feeds.UPDATES),
    transit.WEATHER: (feeds.weather_hourly, feeds.FORECAST),
}


def land_feed(spark: SparkSession, source: str, topic: str, root: str) -> str:
    """Turn a folder of documents, one per file, into messages that ``--mode bronze --source`` reads.

    Documents that are not wholly readable go to ``dlq/{topic}.documents`` with
    the reason. Returns the folder of the messages.
    """
    flatten, schema = FEEDS[topic]
    documents = spark.read.text(source, wholetext=True)
    rows = flatten(documents)
    target = f"{root}/landed/{topic}"
    messages = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.current_timestamp().alias("timestamp"))
    messages.write.mode("append").parquet(target)
    feeds.rejected(documents, schema).withColumn("topic", F.lit(topic)).write.mode("append").parquet(f"{root}/dlq/{topic}.documents")
    return target
