"""Gold table to feature log as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from turnstile.operators.curate import publishable
from turnstile.operators.features import FEATURES, KEY
from turnstile.sources.feature_log import write_batch


def table_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, max_files: int | None = None) -> DataFrame:
    """New files of a Parquet table.

    A file that was listed and then replaced is left out; what replaced it is a
    new file and is read in its place.
    """
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("ignoreMissingFiles", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def published_columns(gold: DataFrame) -> DataFrame:
    """What the snapshot keeps of Gold: key, order and all model features."""
    rows = gold.select(*KEY, "minute", "h3", *FEATURES)
    return publishable(rows, FEATURES, ["h3"])


def start_materializer(
    rows: DataFrame,
    log_path: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = ("minute", "h3"),
    on_counts: Callable[[int, dict[str, int]], None] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Upsert each micro-batch into the feature log."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        counts = write_batch(batch, batch_id, log_path, keys, order)
        if on_counts:
            on_counts(batch_id, counts)

    writer = rows.writeStream.foreachBatch(publish).outputMode("update").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
