"""Silver and Gold on small transit tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnstile.functions.cells import hex_cell
from turnstile.operators.gold import gold_facts
from turnstile.operators.silver import silver_facts, stop_pairs
from turnstile.plans import transit
from turnstile.plans.batch import build_silver, run_gold, run_silver, silver_checks, validate_tables
from turnstile.sources.tables import write_checked

NOON = datetime(2024, 1, 1, 12, 0, 0)
POSITION = "trip_id string, lat double, lon double, speed_mps double, event_ts timestamp"
UPDATE = "trip_id string, stop_id string, arrival_delay_s double, departure_delay_s double, event_ts timestamp"
WEATHER = "event_ts timestamp, temp_c double, wind_mps double, precip_mm double"


def stop_times(spark, data):
    return spark.createDataFrame(data, "trip_id string, stop_id string, stop_sequence string")


def stops(spark, data):
    return spark.createDataFrame(data, "stop_id string, stop_name string, parent_station string")


def one_row_tables(spark):
    return (
        spark.createDataFrame([("ride-7", 42.401, -71.012, 9.0, NOON)], POSITION),
        spark.createDataFrame([("ride-7", "pier", 48.0, 21.0, NOON)], UPDATE),
        spark.createDataFrame([(NOON, 6.5, 3.0, 0.4)], WEATHER),
        stop_times(spark, [("ride-7", "pier", "1")]),
        stops(spark, [("pier", "Harbour Pier", None)]),
    )


def land(spark, root, tables):
    names = (transit.VEHICLES, transit.UPDATES, transit.WEATHER)
    for name, df in zip(names, tables):
        df.withColumn("date", F.to_date("event_ts")).write.partitionBy("date").mode("overwrite").parquet(transit.bronze_path(root, name))
    tables[3].write.mode("overwrite").parquet(f"{transit.schedule_root(root)}/stop_times.parquet")
    tables[4].write.mode("overwrite").parquet(f"{transit.schedule_root(root)}/stops.parquet")


def test_one_row_silver_and_gold(spark, tmp_path):
    root = str(tmp_path)
    land(spark, root, one_row_tables(spark))
    silver = spark.read.parquet(run_silver(spark, root)).collect()
    assert len(silver) == 1
    row = silver[0]
    assert (row["origin_stop"], row["dest_stop"], row["active_trips"]) == ("pier", "unknown", 1)
    assert (row["avg_arrival_delay_s"], row["avg_departure_delay_s"]) == (48.0, 21.0)
    assert (row["avg_temp_c"], row["avg_wind_speed"], row["avg_precip_mm"]) == (6.5, 3.0, 0.4)
    assert row["crowding_score"] == pytest.approx(48.1)
    gold = spark.read.parquet(run_gold(spark, root, [10]))
    assert gold.count() == 1
    row = gold.first()
    assert row["horizon_min"] == 10 and row["label_p50"] is None
    assert row["rolling_mean_7d"] == pytest.approx(48.1) and row["rolling_std_7d"] == 0.0
    assert row["hist_p50"] == row["hist_p90"] == pytest.approx(48.1)
    results = validate_tables(spark, {"silver": transit.silver_path(root), "gold": transit.gold_path(root)})
    assert [r["row_count"] for r in results.collect()] == [1, 1]


def test_silver_run_of_one_date_keeps_the_others(spark, tmp_path):
    root = str(tmp_path)
    first = one_row_tables(spark)
    second = [df.withColumn("event_ts", F.col("event_ts") + F.expr("interval 1 day")) for df in first[:3]]
    land(spark, root, [a.unionByName(b) for a, b in zip(first, second)] + list(first[3:]))
    run_silver(spark, root)
    run_silver(spark, root, date="2024-01-02")
    days = [str(r["date"]) for r in spark.read.parquet(transit.silver_path(root)).orderBy("date").collect()]
    assert days == ["2024-01-01", "2024-01-02"]


def test_null_cell_fails_or_is_quarantined(spark, tmp_path):
    root = str(tmp_path)
    tables = list(one_row_tables(spark))
    tables[0] = tables[0].unionByName(tables[0].withColumn("lat", F.lit(None).cast("double")))
    land(spark, root, tables)
    with pytest.raises(ValueError, match="not_null"):
        run_silver(spark, root)
    assert not (tmp_path / "silver").exists()
    run_silver(spark, root, on_fail="quarantine")
    assert spark.read.parquet(transit.silver_path(root)).count() == 1
    assert spark.read.parquet(f"{root}/quarantine/silver").count() == 1


def test_silver_is_written_once_and_checked_on_the_way(spark, tmp_path):
    root = str(tmp_path)
    land(spark, root, one_row_tables(spark))
    executions = spark._jsparkSession.sharedState().statusStore().executionsCount
    rows = build_silver(spark, root)
    before = executions()
    write_checked(rows, transit.silver_path(root), "date", silver_checks(), "silver")
    assert executions() == before + 1  # the write; no query reads the rows back
    written = [f for f in (tmp_path / "silver").rglob("*") if f.is_file() and f.suffix == ".parquet"]
    assert len(written) == 1 and not [f for f in (tmp_path / "silver").iterdir() if f.name.startswith("_")]
    before = written[0].read_bytes()
    tables = list(one_row_tables(spark))
    tables[0] = tables[0].withColumn("lat", F.lit(None).cast("double"))
    land(spark, root, tables)
    with pytest.raises(ValueError, match="not_null"):
        run_silver(spark, root)
    assert [f.read_bytes() for f in (tmp_path / "silver").rglob("*.parquet")] == [before]


def test_empty_table_fails_validation(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], "a int").write.parquet(path)
    with pytest.raises(ValueError, match="more_rows_than"):
        validate_tables(spark, {"t": path})


def test_stop_order_is_numeric(spark, rows):
    pairs = stop_pairs(stop_times(spark, [("t", "b", "10"), ("t", "a", "2"), ("t", "c", "9"), ("u", "z", "1")]))
    assert rows(pairs) == [("t", "a", "c"), ("t", "c", "b")]


def busy_tables(spark):
    """Two trips, many updates, a parent station, missing coordinates and two
    weather rows in one hour."""
    minute = lambda m: datetime(2024, 1, 1, 12, m, 5)
    positions = [("t1", 42.35, -71.05, 1.0, minute(m)) for m in (0, 0, 1, 5)]
    positions += [("t2", 42.35, -71.05, 1.0, minute(0)), ("t3", 42.35, -71.05, 1.0, minute(1)), ("t1", None, -71.0, 1.0, minute(2))]
    updates = [("t1", "a", 10.0, None, NOON), ("t1", "a", 20.0, 4.0, NOON), ("t1", "b", 60.0, 6.0, NOON), ("t2", "a", None, 8.0, NOON)]
    updates += [("t2", "x", 7.0, 1.0, NOON)]
    weather = [(minute(1), 10.0, 2.0, None), (minute(7), 20.0, 4.0, 1.0)]
    return (
        spark.createDataFrame(positions, POSITION),
        spark.createDataFrame(updates, UPDATE),
        spark.createDataFrame(weather, WEATHER),
        stop_times(spark, [("t1", "a", "1"), ("t1", "b", "2"), ("t1", "c", "3"), ("t2", "a", "1"), ("t2", "c", "2")]),
        stops(spark, [("a", "A", "place-ab"), ("b", "B", "place-ab"), ("c", "C", None)]),
    )


def plain_silver(positions, updates, weather, stop_times, stops):
    """The tables joined row by row, without any early aggregate."""
    from pyspark.sql import Window

    pairs = stop_times.withColumn("dest", F.lead("stop_id").over(Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").cast("int"))))
    pairs = pairs.dropna(subset=["dest"]).select("trip_id", "stop_id", "dest")
    parents = stops.select("stop_id", "parent_station")
    joined = (
        positions.withColumn("minute", F.date_trunc("minute", "event_ts"))
        .withColumn("h3", hex_cell(F.col("lat"), F.col("lon")))
        .select("trip_id", "minute", "h3")
        .join(updates.drop("event_ts").join(pairs, ["trip_id", "stop_id"], "left"), "trip_id", "left")
        .withColumn("hour", F.date_trunc("hour", "minute"))
        .join(weather.withColumn("hour", F.date_trunc("hour", "event_ts")).drop("event_ts"), "hour", "left")
        .join(parents.toDF("stop_id", "op"), "stop_id", "left")
        .join(parents.toDF("dest", "dp"), "dest", "left")
    )
    unknown = F.lit("unknown")
    return joined.groupBy(
        F.coalesce("op", "stop_id", unknown).alias("origin_stop"), F.coalesce("dp", "dest", unknown).alias("dest_stop"), "h3", "minute"
    ).agg(
        F.countDistinct("trip_id").alias("active_trips"),
        F.avg("arrival_delay_s").alias("avg_arrival_delay_s"),
        F.avg("departure_delay_s").alias("avg_departure_delay_s"),
        F.avg("temp_c").alias("avg_temp_c"),
        F.avg("wind_mps").alias("avg_wind_speed"),
        F.avg("precip_mm").alias("avg_precip_mm"),
    )


def test_early_aggregates_equal_the_plain_join(spark, rows):
    tables = busy_tables(spark)
    want = plain_silver(*tables)
    got = silver_facts(*tables)
    assert rows(got, *want.columns) == rows(want)
    assert got.filter("h3 is null").count() > 0


def test_latest_update_only(spark):
    tables = list(busy_tables(spark))
    later = tables[1].filter("trip_id = 't1' and stop_id = 'b'").withColumn("arrival_delay_s", F.lit(0.0))
    tables[1] = tables[1].unionByName(later.withColumn("event_ts", F.col("event_ts") + F.expr("interval 1 hour")))
    got = silver_facts(*tables, dedupe="latest").filter("dest_stop = 'c' and minute(minute) = 5").first()
    assert got["avg_arrival_delay_s"] == 0.0


def silver_series(spark, minutes):
    data = [("o", "d", "c", datetime(2024, 1, 1, 10, m), float(m * m)) for m in minutes]
    return spark.createDataFrame(data, "origin_stop string, dest_stop string, h3 string, minute timestamp, crowding_score double")


def test_row_and_minute_labels_differ_over_gaps(spark):
    silver = silver_series(spark, [0, 1, 2, 5, 6])
    by_rows = gold_facts(silver, horizons=[1, 3], rows_per_slice=2)
    by_minutes = gold_facts(silver, horizons=[1, 3], label_mode="minutes")

    def labels(df, horizon):
        picked = df.filter(F.col("horizon_min") == horizon).orderBy("minute")
        return [r["label_p50"] for r in picked.collect()]

    assert labels(by_rows, 1) == [1.0, 4.0, 25.0, 36.0, None]
    assert labels(by_rows, 3) == [25.0, 36.0, None, None, None]
    assert labels(by_minutes, 1) == [1.0, 4.0, None, 36.0, None]
    assert labels(by_minutes, 3) == [None, None, 25.0, None, None]


def test_quantiles_may_end_at_a_time(spark):
    silver = silver_series(spark, [0, 1, 2, 5, 6])
    whole = gold_facts(silver, horizons=[1]).first()
    early = gold_facts(silver, horizons=[1], as_of="2024-01-01 10:01:00").first()
    assert whole["hist_p90"] == 36.0 and early["hist_p90"] == 1.0
    exact = gold_facts(silver, horizons=[1], exact_quantiles=True).first()
    assert (exact["hist_p50"], exact["hist_p90"]) == (whole["hist_p50"], whole["hist_p90"])


def test_unknown_modes_are_rejected(spark):
    with pytest.raises(ValueError):
        gold_facts(silver_series(spark, [0]), label_mode="hours")
    with pytest.raises(ValueError):
        silver_facts(*one_row_tables(spark), dedupe="first")
