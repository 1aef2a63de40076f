"""A Gold run publishes the partitions that changed, and none if nothing did."""

from pyspark.sql import functions as F

from turnstile.plans import transit
from turnstile.plans.batch import run_gold
from turnstile.streaming.materialize import published_columns, start_materializer, table_stream


def silver(spark, score):
    rows = spark.range(120).select(
        F.lit("a").alias("origin_stop"),
        F.lit("b").alias("dest_stop"),
        F.lit("c").alias("h3"),
        F.timestamp_seconds(F.col("id") * 3600 + 1704067200).alias("minute"),
        F.lit(1).cast("long").alias("active_trips"),
        F.lit(2.0).alias("avg_departure_delay_s"),
    )
    return rows.withColumn("crowding_score", score).withColumn("date", F.to_date("minute"))


def publish(spark, root):
    received = []
    stream = published_columns(table_stream(spark, transit.gold_path(root)))
    start_materializer(
        stream, f"{root}/log", f"{root}/checkpoint", on_counts=lambda _, c: received.append(c["received"]), available_now=True
    ).awaitTermination()
    return sum(received)


def test_only_changes_are_published(spark, tmp_path):
    root = str(tmp_path)
    path = transit.silver_path(root)
    silver(spark, F.lit(1.0)).write.partitionBy("date").parquet(path)
    run_gold(spark, root, [10, 20], exact_quantiles=True, as_of="2024-01-04")
    assert publish(spark, root) == 240
    run_gold(spark, root, [10, 20], exact_quantiles=True, as_of="2024-01-04")
    assert publish(spark, root) == 0
    # the last day changes: its rows, and those whose label reaches it
    changed = F.when(F.col("minute") >= F.lit("2024-01-05").cast("timestamp"), 5.0).otherwise(1.0)
    silver(spark, changed).write.mode("overwrite").partitionBy("date").parquet(path)
    run_gold(spark, root, [10, 20], exact_quantiles=True, as_of="2024-01-04")
    assert 0 < publish(spark, root) < 240
