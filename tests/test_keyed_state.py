"""Feature snapshot in the state of a stream, with the stamps as a manual clock."""

import datetime

import pytest
from pyspark.sql import functions as F

from turnstile.sources.feature_log import read_snapshot
from turnstile.streaming.keyed_state import read_state, start_keyed_state
from turnstile.streaming.materialize import start_materializer, table_stream

START = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, minute int, at timestamp, v double"
TTL = 60


def at(second):
    return None if second is None else START + datetime.timedelta(seconds=second)


@pytest.fixture
def step(spark, tmp_path):
    """Adds rows of (key, minute, second, value), runs the stream, gives what is live at a second and all that expired."""

    def run(rows, now):
        frame = spark.createDataFrame([(k, m, at(s), v) for k, m, s, v in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/table")
        query = start_keyed_state(
            table_stream(spark, f"{tmp_path}/table"), f"{tmp_path}/cp", f"{tmp_path}/gone",
            keys=["k"], order=["minute"], stamp="at", ttl_seconds=TTL, available_now=True,
        )
        query.awaitTermination()
        run.progress = [p.observedMetrics.get("keyed_state") for p in query.recentProgress]
        live = read_state(spark, f"{tmp_path}/cp", ["k"], stamp="at", ttl_seconds=TTL, now=F.lit(at(now)).cast("timestamp"))
        held = spark.read.format("statestore").load(f"{tmp_path}/cp").count()
        gone = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/gone")
        return {r.k: r.v for r in live.collect()}, held, sorted((r.k, r.v) for r in gone.collect())

    return run


def test_keys_expire_by_the_clock(step):
    # null key, null stamp, null value, a repeated row
    rows = [("a", 1, 0, 1.0), ("b", 1, 0, 2.0), ("a", 2, 5, None), ("a", 2, 5, None), (None, 1, 0, 9.0), ("c", 1, None, 9.0)]
    live, held, gone = step(rows, 10)
    assert (live, held, gone) == ({"a": None, "b": 2.0}, 2, [])
    assert [(m["received"], m["wrote"], m["errors"]) for m in step.progress if m and m["received"]] == [(6, 4, 2)]
    # the same state at later times: b is older than a
    live, held, gone = step([("b", 2, 50, 3.0)], 66)
    assert (live, held) == ({"b": 3.0}, 2)
    # a's life ended at 65: dropped from the state and reported
    live, held, gone = step([("d", 1, 100, 4.0)], 100)
    assert (live, held, gone) == ({"b": 3.0, "d": 4.0}, 2, [("a", None)])
    # a comes back with an older minute: a new life; b ends
    live, held, gone = step([("a", 1, 130, 5.0)], 131)
    assert (live, held, gone) == ({"a": 5.0, "d": 4.0}, 2, [("a", None), ("b", 3.0)])
    # rows that are expired when they come do not count
    live, held, gone = step([("z", 1, 20, 7.0)], 131)
    assert (live, held, gone) == ({"a": 5.0, "d": 4.0}, 2, [("a", None), ("b", 3.0)])


def test_older_order_does_not_replace(step):
    live, _, _ = step([("a", 5, 0, 1.0)], 1)
    assert live == {"a": 1.0}
    live, held, _ = step([("a", 4, 10, 2.0)], 11)
    assert (live, held) == ({"a": 1.0}, 1)


def test_two_lives_of_a_key_at_once(spark, step):
    """One batch may hold the end of a life and the start of the next."""
    live, held, gone = step([("a", 5, 0, 1.0), ("a", 1, 100, 2.0), ("b", 1, 70, 3.0)], 101)
    assert (live, held, gone) == ({"a": 2.0, "b": 3.0}, 2, [("a", 1.0)])


def test_state_equals_the_log_and_needs_no_python(spark, tmp_path):
    """Hot key, clashing column names; the same snapshot as the log of batches; a plan of Spark's own operators."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("max"),
        (F.col("id") % 7).alias("key"), F.col("id").alias("value"), F.lit("x").alias("partition_id"),
    )
    keys, order, root = ["max", "key"], ["value"], str(tmp_path)
    rows.repartition(6).write.parquet(f"{root}/table")
    stream = lambda: table_stream(spark, f"{root}/table", max_files=2)
    query = start_keyed_state(stream(), f"{root}/cp", f"{root}/gone", keys=keys, order=order, available_now=True)
    query.awaitTermination()
    plan = query._jsq.explainInternal(True)
    assert "MergingSessions" in plan and "Python" not in plan
    start_materializer(stream(), f"{root}/log", f"{root}/logcp", keys=keys, order=order, available_now=True).awaitTermination()
    columns = ["max", "key", "value", "partition_id"]
    kept = sorted(map(tuple, read_state(spark, f"{root}/cp", keys).select(columns).collect()))
    assert kept == sorted(map(tuple, read_snapshot(spark, f"{root}/log", keys, order).select(columns).collect()))
    # the state holds one row per key, however many batches came
    assert spark.read.format("statestore").load(f"{root}/cp").count() == len(kept)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/table")
    start_keyed_state(
        table_stream(spark, f"{tmp_path}/table"), f"{tmp_path}/cp", f"{tmp_path}/gone", keys=["k"], order=["minute"], available_now=True
    ).awaitTermination()
    assert read_state(spark, f"{tmp_path}/cp", ["k"]).count() == 0
