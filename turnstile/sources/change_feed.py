"""Changes between two states of a table as an append-only feed of upserts and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.operators.slices import _same
from turnstile.sources.feature_log import read_snapshot


def row_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(op, columns of ``new``): ``upsert`` for rows that are new or differ, ``delete`` for keys that are gone.

    One row per key on either side; null keys are equal. Rows are compared by a hash
    of all columns, keys by value; a deleted key has null in all other columns.
    """
    columns = sorted(new.columns)
    hashed = F.xxhash64(*columns)
    before = old.select(new.columns).withColumn("__hash", hashed)
    after = new.withColumn("__hash", hashed)
    upserts = _same(after, before.select(*keys, "__hash"), [*keys, "__hash"], "left_anti").drop("__hash")
    deletes = _same(before, after.select(*keys), list(keys), "left_anti")
    blank = [F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema]
    return upserts.withColumn("op", F.lit("upsert")).unionByName(deletes.select(*blank, F.lit("delete").alias("op")))


def append_changes(changes: DataFrame, path: str, version: int) -> None:
    """Add the changes as one version. Files are only ever added: a repeated version repeats its rows, which upserts and deletes allow."""
    changes.write.mode("append").parquet(f"{path}/version={version}")


def change_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The feed as a stream, with its ``version``."""
    known = spark.read.parquet(path).schema
    schema = T.StructType([*(f for f in known if f.name != "version"), T.StructField("version", T.LongType())])
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_live(spark: SparkSession, path: str, keys: Sequence[str], ttl_seconds: int = 0) -> DataFrame:
    """The snapshot that a log of changes leaves: the last change per key, without deleted keys."""
    rows = read_snapshot(spark, path, keys, ["version"], ttl_seconds)
    return rows.filter("op <> 'delete'").drop("op", "version")
