"""The feature snapshot as an append-only log of batches.

Each batch writes one partition, ``batch_id=N``, with the last row per key. A
replayed batch overwrites its own partition, so a restart repeats nothing. A
reader keeps the last row per key over all batches; writing costs the batch,
not the whole snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnstile.operators.features import KEY, fresh_rows, latest_per_key


def batch_counts(valid: Column) -> list[Column]:
    """Received, accepted and rejected rows, for ``agg`` or ``observe``."""
    good = F.coalesce(valid, F.lit(False))
    return [
        F.count(F.lit(1)).alias("received"),
        F.count_if(good).alias("wrote"),
        F.count_if(~good).alias("errors"),
    ]


def has_keys(keys: Sequence[str]) -> Column:
    valid = F.lit(True)
    for key in keys:
        valid = valid & F.col(key).isNotNull()
    return valid


def write_batch(
    rows: DataFrame, batch_id: int, path: str, keys: Sequence[str] = KEY, order: Sequence[str] = ("minute", "h3")
) -> dict[str, int]:
    """Write the last row per key of a batch; rows without a whole key are
    counted as errors. Returns the batch's counts, observed on the write."""
    payload = [c for c in rows.columns if c not in keys]
    seen = Observation()
    counted = rows.observe(seen, *batch_counts(has_keys(keys)))
    newest = latest_per_key(counted.filter(has_keys(keys)), keys, order, payload)
    (
        newest.withColumn("updated_at", F.current_timestamp())
        .withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )
    return seen.get


def read_snapshot(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = ("minute", "h3"),
    ttl_seconds: int = 0,
) -> DataFrame:
    """Last row per key; with a time to live, only fresh ones."""
    log = spark.read.parquet(path)
    payload = [c for c in log.columns if c not in keys]
    newest = latest_per_key(log, keys, [*order, "batch_id"], payload)
    return fresh_rows(newest, "updated_at", ttl_seconds, F.current_timestamp())


def compact_log(
    spark: SparkSession, path: str, target: str, keys: Sequence[str] = KEY, order: Sequence[str] = ("minute", "h3")
) -> None:
    """Write the snapshot as a new log that further batches can follow."""
    read_snapshot(spark, path, keys, order).hint("rebalance").write.mode("errorifexists").partitionBy("batch_id").parquet(target)
