"""Plans stay as they should: one wide shuffle, no nested loops, no Python."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from turnstile.operators.gold import gold_facts
from turnstile.operators.joins import next_in_sequence
from turnstile.showcase.common import events, minute_facts, table

FOLDER = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_no_hot_key_leaves_the_plain_plan(spark):
    plan = final_plan(next_in_sequence(events(spark, FOLDER), ["user_id"], ["ts", "event_id"], "event_type", "nxt"))
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


def test_gold_sorts_a_stored_silver_once(spark, tmp_path):
    path = str(tmp_path / "silver")
    minute_facts(spark, FOLDER).write.parquet(path)
    plan = final_plan(gold_facts(spark.read.parquet(path), ["event_type"], "minute", "score"))
    # One wide shuffle for labels, statistics and quantiles, one small one for
    # the quantiles themselves, and no join.
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 1


def test_recent_points_limits_rows_before_the_shuffle(spark):
    plan = final_plan(queries()["recent_points"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_what_it_needs(spark):
    counted = events(spark, FOLDER).groupBy("event_type").agg(F.max("ts").alias("ts"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in counted._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", ["gold_fact", "silver_job", "child_rollup", "predict_batch", "series_index", "encoder_window", "resolve_id_or_name"])
def test_no_nested_loops_and_no_python(spark, name):
    plan = final_plan(queries()[name](spark, FOLDER))
    for word in ("NestedLoop", "Cartesian", "EvalPython", "MapInPandas"):
        assert word not in plan


def test_large_sides_are_not_broadcast(spark):
    """With broadcasts off, dimension joins still run, as shuffled joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        left = table(spark, FOLDER, "customer").select("c_nationkey")
        right = table(spark, FOLDER, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        assert "SortMergeJoin" in final_plan(left.join(right, on="c_nationkey", how="left"))
        plan = final_plan(queries()["silver_job"](spark, FOLDER))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_hot_join_key_is_split(spark, tmp_path):
    """AQE cuts the partition of a key that a third of the requests ask for."""
    from turnstile.operators.features import lookup

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 60_000
        key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000)
        spark.range(n).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8).write.parquet(f"{tmp_path}/r")
        snapshot = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
        joined = lookup(spark.read.parquet(f"{tmp_path}/r"), snapshot, ["k"], {"v": 0.0})
        assert "skew=true" in final_plan(joined)
        assert joined.count() == n and joined.filter("not found").count() == 0
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
