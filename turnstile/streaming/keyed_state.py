"""The feature snapshot as keyed state of a stream, with time to live.

A key is a session whose gap is the time to live: each row of the key keeps it alive
for that long, and the state holds the last row by ``order``, nothing else. Once the
watermark is past the session's end Spark drops the state and the row comes out as
expired. Batches, shuffle and state are Spark's own session aggregate, without Python;
rows of a key are merged in their task before they travel. The snapshot is read from
the state of the last finished batch, so a read costs the live keys, not all batches
ever written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstile.operators.features import KEY, fresh_rows, latest_per_key
from turnstile.sources.feature_log import batch_counts, has_keys

#: Lifetime in seconds of keys without a time to live: a hundred years.
FOREVER = 36_500 * 86_400

# State lives on the executors' disks, is logged by changes to the checkpoint folder,
# and hot keys are merged before the shuffle.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def _places(keys: Sequence[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))]


def keyed_state(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], stamp: str, ttl_seconds: int = 0, late_seconds: int = 0
) -> DataFrame:
    """Rows of keys that expired: the last row by ``order`` of each, ties by the other columns.

    ``stamp`` is the clock: a key expires ``ttl_seconds`` (0: never) after its last
    stamp, once the latest stamp of all rows less ``late_seconds`` has reached that. A
    key that comes back starts anew. Rows that are older than the watermark by more than the time
    to live are expired already and do not count; rows without stamp or without a whole
    key are left out and counted as errors in the metrics named ``keyed_state``.
    All columns must be sortable (no maps).
    """
    good = has_keys([*keys, stamp])
    counted = rows.observe("keyed_state", *batch_counts(good)).filter(good)
    picked = counted.select(
        *[F.col(k).alias(p) for k, p in zip(keys, _places(keys), strict=True)],
        F.col(stamp).alias("__stamp"),
        F.struct(F.struct(*order).alias("by"), F.struct(*rows.columns).alias("row")).alias("__row"),
    )
    life = F.session_window("__stamp", f"{ttl_seconds or FOREVER} seconds")
    last = picked.withWatermark("__stamp", f"{late_seconds} seconds").groupBy(*_places(keys), life).agg(F.max("__row").alias("last"))
    return last.select("last.row.*")


def start_keyed_state(
    rows: DataFrame,
    checkpoint: str,
    expired_path: str,
    *,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = ("minute", "h3"),
    stamp: str | None = None,
    ttl_seconds: int = 0,
    late_seconds: int = 0,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the last row per key in the stream's state; expired rows go to ``expired_path``.

    Without ``stamp`` the clock is the time of the batch, kept as ``updated_at``. The
    time to live is part of the state: a stream continues with the one it began with.
    """
    for name, value in SETTINGS.items():
        rows.sparkSession.conf.set(name, value)
    if stamp is None:
        stamp, rows = "updated_at", rows.withColumn("updated_at", F.current_timestamp())
    gone = keyed_state(rows, keys, order, stamp, ttl_seconds, late_seconds)
    writer = gone.writeStream.outputMode("append").format("parquet").option("path", expired_path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_state(
    spark: SparkSession,
    checkpoint: str,
    keys: Sequence[str] = KEY,
    *,
    stamp: str = "updated_at",
    ttl_seconds: int = 0,
    now: Column | None = None,
) -> DataFrame:
    """Last row per live key after the last finished batch; with a time to live, fresh ones at ``now`` only.

    A key may have an expired session beside its new one until the next batch; sessions that
    have ended by ``now`` do not count. The state holds no past: ``now`` is not before the watermark.
    """
    now = F.current_timestamp() if now is None else now
    kept = spark.read.format("statestore").load(checkpoint)
    held = kept.schema["value"].dataType.fields[-1].name
    sessions = kept.select("key.*", F.col("value.session_window.end").alias("__end"), F.col(f"value.{held}").alias("__row"))
    if ttl_seconds:
        sessions = sessions.filter(F.col("__end") > now)
    rows = latest_per_key(sessions, _places(keys), ["__row"], ["__row"]).select("__row.row.*")
    return fresh_rows(rows, stamp, ttl_seconds, now)
