"""Documents in ascending order of a key, one block of the key's range per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST = -(2**63)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def order_key(key: str) -> Column:
    """The key as a long; null comes before every number."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))


def block_bounds(df: DataFrame, key: str) -> list[int]:
    """Lower bounds of the blocks after the first: at most one per shuffle partition."""
    n = partitions(df)
    if n == 1:
        return []
    shares = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(order_key(key), shares, max(10_000, 20 * n)).alias("cuts")).first().cuts
    return sorted(set(cuts or []))


def block_of(key: str, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: a binary search in the plan."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    cuts, value = F.lit(bounds), order_key(key)
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at),
    )


def in_blocks(df: DataFrame, key: str) -> DataFrame:
    """The rows with a column ``block``, one block per partition and sorted by the key in it."""
    bounds = block_bounds(df, key)
    return (
        df.withColumn("block", block_of(key, bounds))
        .repartitionById(len(bounds) + 1, F.col("block"))
        .sortWithinPartitions(order_key(key), "text")
    )
