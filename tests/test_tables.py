"""Tables, checks, column helpers and the job entry."""

import argparse
import json
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnstile.operators import quality
from turnstile.operators.curate import default_missing, in_time_range, on_date, pick_features, require_columns
from turnstile.plans import cli, transit
from turnstile.session import remove_work, shared_folder, work_path
from turnstile.sources.tables import cluster, compact, csv_to_parquet, curve, overwrite_partitions, range_cuts, read_dimension, read_table


def days(spark, *data):
    return spark.createDataFrame(data, "id int, day string").select("id", F.col("day").cast("date").alias("date"))


def test_only_the_written_partitions_are_replaced(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    overwrite_partitions(days(spark, (1, "2024-01-01"), (2, "2024-01-02")), path, ["date"])
    overwrite_partitions(days(spark, (3, "2024-01-02")), path, ["date"])
    assert rows(read_table(spark, path), "id") == [(1,), (3,)]
    assert rows(read_table(spark, path, "2024-01-02"), "id") == [(3,)]


def test_date_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_partitions(days(spark, (1, "2024-01-01"), (2, "2024-01-02")), path, ["date"])
    plan = read_table(spark, path, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_one_date_lists_one_folder(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    overwrite_partitions(days(spark, (1, "2024-01-01"), (2, "2024-01-02")), path, ["date"])
    one = read_table(spark, path, "2024-01-02")
    assert len(one.inputFiles()) == 1 and rows(one, "id", "date")[0][1].isoformat() == "2024-01-02"
    assert read_table(spark, path, "2023-01-01").count() == 0
    plain = str(tmp_path / "plain")
    days(spark, (1, "2024-01-01"), (2, "2024-01-02")).write.parquet(plain)
    assert rows(read_table(spark, plain, "2024-01-02"), "id") == [(2,)]


def test_time_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(datetime(2024, 1, d), d) for d in (1, 2, 3)], "ts timestamp, id int")
    df.write.parquet(path)
    got = in_time_range(spark.read.parquet(path), "ts", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert got.count() == 2
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual" in got._jdf.queryExecution().executedPlan().toString()
    assert in_time_range(df, "ts").count() == 3 and on_date(df, "ts", None).count() == 3


def test_schedule_files(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name,parent_station\n007,"Park, ""Old"" St",\n')
    found = csv_to_parquet(spark, str(tmp_path), str(tmp_path / "out"))
    assert found == ["stops"]
    row = read_dimension(spark, str(tmp_path / "out"), "stops").first()
    assert tuple(row) == ("007", 'Park, "Old" St', None)
    assert read_dimension(spark, str(tmp_path / "out"), "stops", {"stop_id": "int"}).first()["stop_id"] == 7


def test_merging_stream_batches(spark, tmp_path, rows):
    path, archive = str(tmp_path / "t"), str(tmp_path / "archive")
    for batch in range(4):
        stamped = days(spark, (batch, "2024-01-01"), (batch + 10, "2024-01-02")).withColumn("batch_id", F.lit(batch))
        overwrite_partitions(stamped, path, ["date", "batch_id"])
    compact(spark, path, ["id"], partition_by=["date"], target=archive, date="2024-01-01", files=1)
    assert rows(read_table(spark, archive), "id", "batch_id") == [(i, i) for i in range(4)]
    assert len(read_table(spark, archive).inputFiles()) == 1


def test_compaction_keeps_rows(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = days(spark, *[(i, f"2024-01-0{i % 3 + 1}") for i in range(60)])
    df.repartition(6).write.partitionBy("date").parquet(path)
    before = len(list((tmp_path / "t").rglob("*.parquet")))
    compact(spark, path, ["id"], partition_by=["date"], files=1)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 3 < before
    compact(spark, path, ["id"], partition_by=["date"], date="2024-01-02")
    assert rows(read_table(spark, path), "id") == rows(df, "id")
    compact(spark, path, ["id"], target=str(tmp_path / "flat"), files=1)
    ids = [r["id"] for r in spark.read.parquet(str(tmp_path / "flat")).collect()]
    assert ids == sorted(ids)
    with pytest.raises(ValueError):
        compact(spark, path, ["id"])


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (-3, 7.0)], "a int, b double")
    suite = [quality.not_null("b"), quality.between("a", low=0), quality.between("b", 0, 6), quality.more_rows_than(2), quality.more_rows_than(3)]
    results = quality.run_checks(df, "t", suite)
    assert [(r["failed"], r["success"]) for r in results.collect()] == [(1, False), (1, False), (1, False), (0, True), (0, False)]
    with pytest.raises(ValueError, match="not_null"):
        quality.enforce(results)
    assert len(quality.enforce(quality.run_checks(df, "t", [quality.more_rows_than(0)]))) == 1
    good, bad = quality.quarantine(df, suite)
    assert (good.count(), bad.count()) == (1, 2)


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    with pytest.raises(ValueError, match=r"\['z'\]"):
        require_columns(df, ["a", "z"])
    assert pick_features(df, ["b", "q"], []) == ["b"]
    assert pick_features(df, ["q"], ["a"]) == ["b"]
    with pytest.raises(ValueError):
        pick_features(df, ["q"], ["a", "b"])
    assert default_missing(df, {"b": 2.0, "c": "x"}).first().asDict() == {"a": 1, "b": 2.0, "c": "x"}


def run(spark, *argv) -> object:
    return cli.run(spark, cli.parser().parse_args([str(a) for a in argv]))


def landed(spark, folder, *documents):
    sent = datetime(2024, 1, 1, 12, 0, 30)
    spark.createDataFrame([(json.dumps(d), sent) for d in documents], "value string, timestamp timestamp").write.parquet(folder)


def test_every_job_from_messages_to_predictions(spark, tmp_path):
    root = tmp_path / "data"
    noon = 1704110400
    trips = [(f"t{i % 3}", noon + 60 * i) for i in range(60)]
    feeds = {
        transit.VEHICLES: [
            {"vehicle_id": "v", "route_id": "r", "trip_id": t, "lat": 42.35, "lon": -71.06, "speed_mps": None, "timestamp": s} for t, s in trips
        ],
        transit.UPDATES: [
            {"trip_id": f"t{i}", "stop_id": s, "arrival_delay_s": 10 * i, "departure_delay_s": 5, "timestamp": noon} for i in range(3) for s in "ab"
        ],
        transit.WEATHER: [{"temp_c": 10.0, "timestamp": noon}],
    }
    for topic, documents in feeds.items():
        landed(spark, f"{tmp_path}/landed/{topic}", *documents)
        run(spark, "--mode", "bronze", "--topic", topic, "--data-root", root, "--source", f"{tmp_path}/landed/{topic}", "--available-now")
    schedule = tmp_path / "schedule"
    schedule.mkdir()
    (schedule / "stops.txt").write_text("stop_id,stop_name,parent_station\na,A,place-a\nb,B,\nplace-a,Alewife,\n")
    times = "".join(f"t{i},a,2\nt{i},b,10\n" for i in range(3))
    (schedule / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence\n" + times)
    assert run(spark, "--mode", "schedule", "--data-root", root, "--source", schedule) == ["stops", "stop_times"]
    run(spark, "--mode", "silver", "--data-root", root)
    run(spark, "--mode", "gold", "--data-root", root, "--horizons", 10, 20)
    assert run(spark, "--mode", "validate", "--data-root", root).count() == 2
    gold = spark.read.parquet(f"{root}/gold")
    assert {(r["origin_stop"], r["dest_stop"]) for r in gold.select("origin_stop", "dest_stop").distinct().collect()} == {
        ("place-a", "b"),
        ("b", "unknown"),
    }
    rows = gold.count()
    run(spark, "--mode", "compact", "--data-root", root, "--table", "gold")
    assert spark.read.parquet(f"{root}/gold").count() == rows
    run(spark, "--mode", "materialize", "--data-root", root, "--available-now")
    run(spark, "--mode", "train", "--data-root", root, "--rounds", 2)
    asked = [("ALEWIFE", "b", 10), ("place-a", "b", 20), ("zz", "b", 10), ("place-a", "b", 1)]
    spark.createDataFrame(asked, "origin_stop string, dest_stop string, horizon_min int").write.parquet(f"{tmp_path}/asked")
    run(spark, "--mode", "predict", "--data-root", root, "--source", f"{tmp_path}/asked", "--target", f"{tmp_path}/answers")
    answers = {(r["origin_stop"], r["horizon_min"]): r for r in spark.read.parquet(f"{tmp_path}/answers").collect()}
    assert {k: v["source"] for k, v in answers.items()} == {("place-a", 10): "direct", ("place-a", 20): "direct", ("zz", 10): "default"}
    assert answers[("place-a", 10)]["origin_name"] == "Alewife" and answers[("place-a", 10)]["p50"] > 0


def test_predict_needs_valid_requests(spark, tmp_path):
    (tmp_path / "gtfs").mkdir()
    stops = spark.createDataFrame([], "stop_id string, stop_name string, parent_station string")
    stops.write.parquet(f"{tmp_path}/gtfs/stops.parquet")
    spark.createDataFrame([("a", "b", 1)], "origin_stop string, dest_stop string, horizon_min int").write.parquet(f"{tmp_path}/asked")
    with pytest.raises(ValueError, match="no valid requests"):
        run(spark, "--mode", "predict", "--data-root", tmp_path, "--source", f"{tmp_path}/asked", "--target", f"{tmp_path}/out")


def test_mode_is_required():
    with pytest.raises(SystemExit):
        cli.parser().parse_args([])
    assert isinstance(cli.parser().parse_args(["--mode", "gold"]), argparse.Namespace)


def test_evolved_schema_is_merged_on_read(spark, tmp_path):
    path = str(tmp_path / "t")
    days(spark, (1, "2024-01-01")).write.partitionBy("date").parquet(path)
    days(spark, (2, "2024-01-02")).withColumn("extra", F.lit("x")).write.mode("append").partitionBy("date").parquet(path)
    got = {r["id"]: r["extra"] for r in read_table(spark, path, merge_schema=True).collect()}
    assert got == {1: None, 2: "x"}


def test_only_work_paths_are_removed(spark, tmp_path):
    path = work_path(spark, "x")
    spark.range(1).write.parquet(path)
    remove_work(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    for other in (str(tmp_path), shared_folder(spark)):
        with pytest.raises(ValueError):
            remove_work(spark, other)


def file_shares(path, column, value):
    """The share of a table's files whose statistics of a column cannot rule a value out."""
    files = [pq.ParquetFile(f) for f in sorted(Path(path).rglob("*.parquet"))]
    hit = 0
    for f in files:
        at = f.schema_arrow.names.index(column)
        stats = [f.metadata.row_group(g).column(at).statistics for g in range(f.metadata.num_row_groups)]
        hit += any(s is None or not s.has_min_max or s.min <= value <= s.max for s in stats)
    return hit / len(files)


def test_clustered_files_skip_on_every_column(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "id", "(id * 7919) % 1000 as a", "concat('k', lpad(string((id * 104729) % 997), 4, '0')) as b",
        "timestamp_seconds((id * 15485863) % 100003) as c", "if(id % 50 = 0, null, id % 7) as d",
    )
    rows.write.parquet(f"{tmp_path}/t")
    compact(spark, f"{tmp_path}/t", ["a", "b", "c"], target=f"{tmp_path}/linear", files=64)
    cluster(spark, f"{tmp_path}/t", ["a", "b", "c"], target=f"{tmp_path}/curve", files=64)
    found = spark.read.parquet(f"{tmp_path}/curve")
    assert found.columns == rows.columns and found.exceptAll(rows).isEmpty() and found.count() == 20_000
    some = rows.filter("id in (5, 777, 15000)").collect()
    for r in some:
        assert file_shares(f"{tmp_path}/curve", "a", r.a) < 0.4
        assert file_shares(f"{tmp_path}/curve", "b", r.b) < 0.4
        assert file_shares(f"{tmp_path}/linear", "b", r.b) > 0.9
    cuts = range_cuts(rows, ["a", "d"], 3)
    assert len(cuts["a"]) == 7 and cuts["a"] == sorted(cuts["a"])
    places = spark.createDataFrame([(None, None), (0, 0), (999, 6)], rows.select("a", "d").schema)
    assert [r[0] for r in places.select(curve(cuts, rows.schema, 3)).collect()][0] == 0
    with pytest.raises(ValueError, match="columns"):
        cluster(spark, f"{tmp_path}/t", [], target=f"{tmp_path}/x")
    spark.range(0).selectExpr("id as a").write.parquet(f"{tmp_path}/none")
    assert spark.read.parquet(cluster(spark, f"{tmp_path}/none", ["a"], target=f"{tmp_path}/none2", files=2)).count() == 0
