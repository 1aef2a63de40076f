"""Topic to Bronze and dead letters in one streaming query."""

from __future__ import annotations

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from turnstile.sources.tables import read_table, swap_partitions
from turnstile.sources.topics import bronze_rows, dead_letters, decode, split_messages


def dead_letters_enabled() -> bool:
    return int(os.getenv("DLQ_ENABLE", "1")) != 0


def write_messages(
    messages: DataFrame,
    batch_id: int,
    schema: T.StructType,
    topic: str,
    bronze_path: str,
    dlq_path: str | None,
    epoch: str | None = "timestamp",
) -> None:
    """Parse a batch once and write its good and bad rows.

    Both tables are also partitioned by ``batch_id``, and a write replaces just
    the partitions it holds, so a batch that is run again leaves no copies.
    Late rows go to the date and hour of their event. ``merge_batches`` joins the
    batches of a finished date.
    """
    decoded = decode(messages, schema, epoch).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good, bad = split_messages(decoded)
        batch = F.lit(int(batch_id)).cast("long")
        (
            bronze_rows(good, epoch)
            .withColumn("batch_id", batch)
            .hint("rebalance", "date", "hour")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "hour", "batch_id")
            .parquet(bronze_path)
        )
        if dlq_path:
            (
                dead_letters(bad, topic)
                .withColumn("batch_id", batch)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(dlq_path)
            )
    finally:
        decoded.unpersist()


#: The batch that holds the merged rows of a date.
MERGED = -1


def merge_batches(spark: SparkSession, path: str, date: str) -> int:
    """Join the micro-batch folders of a finished date into one per hour; returns the number of files before.

    The rows, but for ``batch_id``, stay the same and the date is swapped in by
    renaming. Run it when no stream writes to the date any more: if files came while
    the rows were copied, nothing is changed and ``RuntimeError`` says so. A batch of
    before must not be run again afterwards.
    """

    def listed() -> list[str]:
        return sorted(read_table(spark, path, date).inputFiles())

    before = listed()
    if not before:
        return 0
    staged = f"{path}/_merged-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        rows = read_table(spark, path, date).withColumn("batch_id", F.lit(MERGED).cast("long"))
        rows.hint("rebalance", "date", "hour").write.partitionBy("date", "hour", "batch_id").parquet(staged)
        spark.catalog.refreshByPath(path)
        if listed() != before:
            raise RuntimeError(f"rows of {date} came while its batches were merged")
        swap_partitions(spark, staged, path, "date")
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(before)


def start_bronze(
    messages: DataFrame,
    schema: T.StructType,
    topic: str,
    data_root: str,
    *,
    checkpoint: str | None = None,
    dead_letter: bool | None = None,
    available_now: bool = False,
    epoch: str | None = "timestamp",
) -> StreamingQuery:
    """Start the ingest of one topic below ``data_root``.

    A restart with the same checkpoint goes on after the last whole batch. One
    query writes both tables, so a failed dead-letter write stops the ingest
    instead of passing unseen.
    """
    dead_letter = dead_letters_enabled() if dead_letter is None else dead_letter
    bronze_path = f"{data_root}/bronze/{topic}"
    dlq_path = f"{data_root}/dlq/{topic}" if dead_letter else None

    def write(batch: DataFrame, batch_id: int) -> None:
        write_messages(batch, batch_id, schema, topic, bronze_path, dlq_path, epoch)

    writer = messages.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint or f"{data_root}/checkpoints/{topic}"
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
