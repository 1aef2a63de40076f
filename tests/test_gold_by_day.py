"""Gold by the day equals Gold of the whole, reads changed days alone and publishes changes alone."""

import datetime
import glob
import random

import pytest
from pyspark.sql import functions as F

from turnstile.operators.gold import gold_facts
from turnstile.plans import transit
from turnstile.plans.incremental import read_gold_by_day, run_gold_by_day, run_silver_by_day, state_path
from turnstile.sources.change_feed import change_stream, read_live, row_changes
from turnstile.sources.tables import overwrite_partitions
from turnstile.streaming.materialize import start_materializer

KEYS = ["series", "cell"]
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "series string, cell string, minute timestamp, extra long, score double"


def made(days, seed, per_day=25):
    rng = random.Random(seed)
    rows = []
    for day in days:
        for series in ("a", "b", None):
            for minute in sorted(rng.sample(range(1440), rng.choice([1, 3, per_day]))):
                at = START + datetime.timedelta(days=day, minutes=minute if rng.random() < 0.95 else 0)
                rows.append((series, "x", at, rng.randrange(9), rng.choice([None, float("nan"), 1.5, 2.25, rng.random()])))
    return list({(r[0], r[2]): r for r in rows}.values())


def store(spark, rows, path):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("minute"))
    overwrite_partitions(frame, path, ["date"])


def shown(df):
    columns = ["series", "cell", "minute", "extra", "score", "horizon_min", "label_p50", "rolling_mean_7d", "rolling_std_7d", "hist_p50", "hist_p90", "date"]
    return sorted((tuple(map(str, r)) for r in df.select(columns).collect()))


def same(spark, silver, gold):
    whole = gold_facts(spark.read.parquet(silver), KEYS, "minute", "score", [2, 30], exact_quantiles=True)
    # the stored quantiles leave NaN out, those of the whole job count it as the largest
    sound = whole.drop("hist_p50", "hist_p90").join(
        spark.read.parquet(silver).filter("not isnan(score)").groupBy(KEYS).agg(
            *[F.expr(f"percentile_disc({p}) within group (order by score)").alias(name) for name, p in (("hist_p50", 0.5), ("hist_p90", 0.9))]
        ),
        KEYS,
        "left",
    )
    assert shown(read_gold_by_day(spark, gold, KEYS)) == shown(sound)


def update(spark, silver, gold, **options):
    return run_gold_by_day(spark, silver, gold, keys=KEYS, score="score", horizons=[2, 30], sketch=4096, **options)


def spoil(path, day):
    """Overwrite the files of a day in place: whoever reads them fails."""
    date = (START + datetime.timedelta(days=day)).date()
    for file in glob.glob(f"{path}/date={date}/*.parquet"):
        with open(file, "wb") as out:
            out.write(b"unreadable")
    for crc in glob.glob(f"{path}/date={date}/.*.crc"):
        with open(crc, "wb") as out:
            out.write(b"")


@pytest.mark.parametrize("rows_per_slice", [None, 10])
def test_equal_to_the_whole_after_each_change(spark, tmp_path, rows_per_slice):
    silver, gold = f"{tmp_path}/silver", f"{tmp_path}/gold"
    days = [0, 1, 2, 5, 8, 9, 13]
    store(spark, made(days, 1), silver)
    assert update(spark, silver, gold, rows_per_slice=rows_per_slice)["computed"] == sorted(19723 + d for d in days)
    assert update(spark, silver, gold)["computed"] == []
    for step, late in enumerate(([2], [4, 13, 20])):  # an old day; then one in a gap, the last and a new one
        store(spark, made(late, 10 + step), silver)
        found = update(spark, silver, gold, rows_per_slice=rows_per_slice)
        assert found["changed"] == [19723 + d for d in late]
        same(spark, silver, gold)


def test_unchanged_days_are_not_read(spark, tmp_path):
    silver, gold = f"{tmp_path}/silver", f"{tmp_path}/gold"
    store(spark, made(range(40), 3, 60), silver)
    update(spark, silver, gold)
    store(spark, made([39], 4, 60), silver)
    whole = spark.read.parquet(silver)
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    wanted = gold_facts(whole.drop("date"), KEYS, "minute", "score", [2, 30], exact_quantiles=True)
    # a day may hold three rows only, so a label 30 rows ahead can reach over ten days and more
    for day in range(1, 8):  # the schema comes from the footer of the first file
        spoil(silver, day)
    found = update(spark, silver, gold)
    assert found["changed"] == [19723 + 39]
    assert min(found["computed"]) > 19723 + 14
    columns = ["series", "minute", "horizon_min", "label_p50", "rolling_mean_7d", "rolling_std_7d"]
    stored = spark.read.parquet(state_path(gold, "facts")).select(columns).collect()
    assert sorted(map(str, stored)) == sorted(map(str, wanted.select(columns).collect()))


def test_a_removed_day_leaves_gold(spark, tmp_path):
    silver, gold = f"{tmp_path}/silver", f"{tmp_path}/gold"
    store(spark, made([0, 1, 2], 5), silver)
    update(spark, silver, gold)
    smaller = f"{tmp_path}/smaller"
    spark.read.parquet(silver).filter("date <> '2024-01-02'").write.partitionBy("date").parquet(smaller)
    assert update(spark, smaller, gold)["gone"] == [19724]
    same(spark, smaller, gold)


def publish(spark, gold, root):
    received = []
    stream = change_stream(spark, state_path(gold, "changes"))
    start_materializer(
        stream, f"{root}/log", f"{root}/checkpoint", keys=[*KEYS, "horizon_min"], order=("version",),
        on_counts=lambda _, c: received.append(c["received"]), available_now=True,
    ).awaitTermination()
    return sum(received)


def test_feed_carries_changes_and_deletes(spark, tmp_path):
    silver, gold = f"{tmp_path}/silver", f"{tmp_path}/gold"
    at = lambda day, minute: START + datetime.timedelta(days=day, minutes=minute)
    rows = [(s, "x", at(d, m), 1, 1.0) for s in ("a", "b") for d in (0, 1) for m in (1, 2, 3)] + [("c", "x", at(1, 5), 1, 4.0)]
    store(spark, rows, silver)
    update(spark, silver, gold)
    assert publish(spark, gold, tmp_path) == 6  # three series, two horizons
    assert update(spark, silver, gold)["changed"] == []
    assert publish(spark, gold, tmp_path) == 0
    # one row of b changes, and the only row of c goes
    later = [r for r in rows if r[2] >= at(1, 0) and r[0] != "c"]
    store(spark, [(*r[:3], 9, r[4]) if r[0] == "b" and r[2] == at(1, 3) else r for r in later], silver)
    update(spark, silver, gold)
    assert publish(spark, gold, tmp_path) == 4
    live = read_live(spark, f"{tmp_path}/log", [*KEYS, "horizon_min"])
    assert sorted((r.series, r.horizon_min, r.extra) for r in live.collect()) == [("a", 2, 1), ("a", 30, 1), ("b", 2, 9), ("b", 30, 9)]


def test_row_changes(spark):
    schema = "k string, n long, v double"
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None), (None, 1, 2.0), ("d", 1, 4.0), (None, None, 1.0)], schema)
    new = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0), (None, 1, 2.0), ("e", 1, None)], schema)
    got = sorted(map(str, ((r.op, r.k, r.n, r.v) for r in row_changes(old, new, ["k", "n"]).collect())))
    assert got == sorted(map(str, [("upsert", "b", 1, 3.0), ("upsert", "e", 1, None), ("delete", "d", 1, None), ("delete", None, None, None)]))


def test_job_modes_by_day(spark, tmp_path):
    from turnstile.plans.cli import parser, run, snapshot

    root = str(tmp_path)
    rows = [("s1", "s2", cell, START + datetime.timedelta(minutes=m), 3, 1.5, 2.0 * m) for m in range(40) for cell in ("u", "v")]
    frame = spark.createDataFrame(
        rows, "origin_stop string, dest_stop string, h3 string, minute timestamp, active_trips long, avg_departure_delay_s double, crowding_score double"
    )
    overwrite_partitions(frame.withColumn("date", F.to_date("minute")), f"{root}/silver", ["date"])

    def mode(*words):
        return run(spark, parser().parse_args(["--data-root", root, "--by-day", *words]))

    assert len(mode("--mode", "gold", "--horizons", "5", "10")["computed"]) == 1
    mode("--mode", "materialize", "--available-now")
    args = parser().parse_args(["--data-root", root, "--by-day", "--mode", "map"])
    kept = snapshot(spark, root, args).collect()
    assert sorted((r.horizon_min, r.h3) for r in kept) == [(5, "v"), (10, "v")]
    assert {r.minute for r in snapshot(spark, root, args).select(F.col("minute").cast("string").alias("minute")).collect()} == {"2024-01-01 00:39:00"}


def bronze(spark, root, days, vehicle):
    """A position and an update per day, as files of their dates."""
    for day in days:
        at = START + datetime.timedelta(days=day, hours=12)
        where = spark.createDataFrame([(f"trip-{day}-{vehicle}", 42.4, -71.0, 9.0, at)], "trip_id string, lat double, lon double, speed_mps double, event_ts timestamp")
        due = spark.createDataFrame(
            [(f"trip-{day}-{vehicle}", "pier", 48.0, 21.0, at)],
            "trip_id string, stop_id string, arrival_delay_s double, departure_delay_s double, event_ts timestamp",
        )
        wind = spark.createDataFrame([(at, 6.5, 3.0, 0.4)], "event_ts timestamp, temp_c double, wind_mps double, precip_mm double")
        for topic, df in ((transit.VEHICLES, where), (transit.UPDATES, due), (transit.WEATHER, wind)):
            df.withColumn("date", F.to_date("event_ts")).write.mode("append").partitionBy("date").parquet(transit.bronze_path(root, topic))


def test_a_late_row_brings_back_its_date_and_what_follows(spark, tmp_path):
    root = str(tmp_path)
    schedule = transit.schedule_root(root)
    trips = [(f"trip-{d}-{v}", "pier", "1") for d in range(20) for v in "ab"]
    spark.createDataFrame(trips, "trip_id string, stop_id string, stop_sequence string").write.parquet(f"{schedule}/stop_times.parquet")
    stops = spark.createDataFrame([("pier", "Harbour Pier", None)], "stop_id string, stop_name string, parent_station string")
    stops.write.parquet(f"{schedule}/stops.parquet")
    bronze(spark, root, [0, 2, 4, 11], "a")
    silver, gold = transit.silver_path(root), transit.gold_days_path(root)
    assert run_silver_by_day(spark, root) == ["2024-01-01", "2024-01-03", "2024-01-05", "2024-01-12"]
    assert run_silver_by_day(spark, root) == []
    run_gold_by_day(spark, silver, gold, horizons=[1])
    bronze(spark, root, [2], "b")
    assert run_silver_by_day(spark, root) == ["2024-01-03"]
    # the day itself, the one whose window holds it, and the one whose label is its row
    assert run_gold_by_day(spark, silver, gold, horizons=[1])["computed"] == [19723 + d for d in (0, 2, 4)]
    got = {(str(r.date), r.active_trips, r.label_p50) for r in read_gold_by_day(spark, gold).collect()}
    scores = {str(r.date): r.crowding_score for r in spark.read.parquet(silver).collect()}
    order = sorted(scores)
    assert got == {(d, 2 if d == "2024-01-03" else 1, scores.get(n)) for d, n in zip(order, [*order[1:], None], strict=True)}
    mode("--mode", "materialize", "--available-now", "--keyed-state", "--feature-ttl", "86400")
    args = parser().parse_args(["--data-root", root, "--by-day", "--mode", "map", "--keyed-state", "--feature-ttl", "86400"])
    held = snapshot(spark, root, args)
    assert sorted(map(str, held.drop("updated_at").collect())) == sorted(str(r) for r in spark.createDataFrame(kept).select(held.drop("updated_at").columns).collect())
