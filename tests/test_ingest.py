"""Decoding, dead letters and the Bronze stream."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnstile.plans import cli, transit
from turnstile.sources import feeds
from turnstile.sources.json_schema import load_schema, required_fields, struct_type
from turnstile.sources.tables import read_table
from turnstile.sources.topics import bronze_rows, decode, file_stream, split_messages
from turnstile.streaming.bronze import merge_batches, start_bronze, write_messages

SCHEMA = transit.payload_schema(transit.UPDATES)
SENT = datetime(2024, 1, 2, 3, 4, 5)


def update(**fields):
    return json.dumps({"trip_id": "t", "stop_id": "s", "arrival_delay_s": 5, "timestamp": 1704067200} | fields)


def messages(spark, *texts):
    return spark.createDataFrame([(t, SENT) for t in texts], "value string, timestamp timestamp")


@pytest.mark.parametrize(
    "text, reason",
    [
        (update(), None),
        (update(arrival_delay_s=None), None),
        (update(extra={"a": 1}), None),
        (update(timestamp=None), "missing timestamp"),
        (update(trip_id=None), "missing trip_id"),
        (update(arrival_delay_s="late"), "type"),
        (update(timestamp="x"), "type"),
        ('{"trip_id": "t", "timestamp": 1}', "missing stop_id"),
        ("not json", "malformed"),
        ('{"trip_id": "t"', "malformed"),
        ("[]", "malformed"),
        ("[1, 2]", "malformed"),
        ("null", "malformed"),
        ("17", "malformed"),
        ("", "empty"),
        ("   ", "empty"),
        (None, "empty"),
    ],
)
def test_reason(spark, text, reason):
    got = decode(messages(spark, text), SCHEMA).first()["reason"]
    assert got == reason
    good, bad = split_messages(decode(messages(spark, text), SCHEMA))
    assert (good.count(), bad.count()) == ((1, 0) if reason is None else (0, 1))


def test_bronze_columns_and_times(spark):
    row = bronze_rows(decode(messages(spark, update()), SCHEMA)).first()
    assert (row["trip_id"], row["arrival_delay_s"], row["departure_delay_s"]) == ("t", 5, None)
    assert (row["event_ts"], str(row["date"]), row["hour"]) == (datetime(2024, 1, 1), "2024-01-01", "00")
    assert row["kafka_ts"] == SENT and "_corrupt_record" not in row.asDict()


def test_event_time_falls_back_to_broker_time(spark):
    schema = struct_type({"properties": {"a": {"type": "string"}, "timestamp": {"type": ["integer", "null"]}}})
    row = bronze_rows(decode(messages(spark, '{"a": "x", "timestamp": null}'), schema)).first()
    assert (row["event_ts"], row["hour"]) == (SENT, "03")


def run_stream(spark, root, **options):
    stream = file_stream(spark, f"{root}/landed", max_files=1)
    start_bronze(stream, SCHEMA, transit.UPDATES, root, available_now=True, **options).awaitTermination()


def stored(spark, root, name):
    return spark.read.parquet(f"{root}/{name}/{transit.UPDATES}")


def test_stream_restart_continues(spark, tmp_path):
    root = str(tmp_path)
    for text in (update(trip_id="a"), "broken"):
        messages(spark, text).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    run_stream(spark, root)
    run_stream(spark, root)
    assert stored(spark, root, "bronze").count() == 1
    assert stored(spark, root, "dlq").first()["raw_value"] == "broken"
    messages(spark, update(trip_id="b", timestamp=1703980800)).write.mode("append").parquet(f"{root}/landed")
    run_stream(spark, root)
    rows = {r["trip_id"]: str(r["date"]) for r in stored(spark, root, "bronze").collect()}
    assert rows == {"a": "2024-01-01", "b": "2023-12-31"}


def test_replayed_batch_leaves_no_copies(spark, tmp_path):
    root = str(tmp_path)
    batch = messages(spark, update(trip_id="a"), update(trip_id="b"), "broken")
    for batch_id in (0, 1, 1):
        write_messages(batch, batch_id, SCHEMA, "t", f"{root}/bronze", f"{root}/dlq")
    assert spark.read.parquet(f"{root}/bronze").count() == 4
    assert spark.read.parquet(f"{root}/dlq").count() == 2


def test_dead_letters_can_be_switched_off(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("DLQ_ENABLE", "0")
    root = str(tmp_path)
    messages(spark, update(), "broken").write.parquet(f"{root}/landed")
    run_stream(spark, root)
    assert stored(spark, root, "bronze").count() == 1
    assert not (tmp_path / "dlq").exists()


def test_stopped_query_ends(spark, tmp_path):
    root = str(tmp_path)
    messages(spark, update()).write.parquet(f"{root}/landed")
    query = start_bronze(file_stream(spark, f"{root}/landed"), SCHEMA, transit.UPDATES, root)
    query.processAllAvailable()
    query.stop()
    assert not query.isActive and stored(spark, root, "bronze").count() == 1


def test_schema_files(spark, tmp_path):
    spec = {
        "properties": {
            "id": {"type": "integer"},
            "speed": {"type": ["null", "number"]},
            "place": {"type": "object", "properties": {"lat": {"type": "number"}}, "required": ["lat"]},
            "tags": {"type": "array", "items": {"type": "string"}},
            "ok": {"type": "boolean"},
        },
        "required": ["id"],
    }
    (tmp_path / "x.value.schema.json").write_text(json.dumps(spec))
    schema = load_schema(spark, "x", str(tmp_path))
    assert schema.simpleString() == "struct<id:bigint,speed:double,place:struct<lat:double>,tags:array<string>,ok:boolean>"
    assert required_fields(schema) == ["id"]
    with pytest.raises(FileNotFoundError):
        load_schema(spark, "y", str(tmp_path))
    for broken in ("", "{", "[]", "{}"):
        (tmp_path / "z.value.schema.json").write_text(broken)
        with pytest.raises(ValueError, match="topic z"):
            load_schema(spark, "z", str(tmp_path))
    assert transit.contract(spark, transit.UPDATES, str(tmp_path)) == SCHEMA
    with pytest.raises(FileNotFoundError):
        transit.contract(spark, "y", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        transit.payload_schema("y")
    with pytest.raises(ValueError):
        struct_type({"properties": {"a": {"type": "null"}}})


def documents(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")


NOW = 1700000000


def now():
    return F.lit(NOW).cast("long")


def test_vehicle_feed(spark, rows):
    full = {
        "vehicle": {"id": "v"},
        "trip": {"trip_id": "t", "route_id": "r"},
        "position": {"latitude": 42.0, "longitude": -71.0, "speed": 3.5},
        "timestamp": 17,
    }
    feed = {"entity": [{"vehicle": full}, {"vehicle": {"position": {"latitude": 1.0}}}, {"vehicle": {"trip": {"trip_id": "x"}}}, {"alert": {}}]}
    got = feeds.vehicle_positions(documents(spark, feed, {"entity": []}, {}), now=now())
    assert rows(got) == [("", "", "", 1.0, None, 0.0, NOW), ("v", "t", "r", 42.0, -71.0, 3.5, 17)]


def test_update_feed(spark, rows):
    entity = {"trip_update": {"trip": {"trip_id": "t"}, "stop_time_update": [{"stop_id": "a", "arrival": {"delay": 9}}, {}]}}
    got = feeds.trip_updates(documents(spark, {"entity": [entity, {"trip_update": {}}]}), now=now())
    assert rows(got) == [("t", "", 0, 0, NOW), ("t", "a", 9, 0, NOW)]


def test_forecast_feed(spark):
    periods = [
        {"temperature": 50, "temperatureUnit": "f", "windSpeed": "5 to 10 mph", "shortForecast": "Rain"},
        {"temperature": 10, "windSpeed": "calm"},
        {"windSpeed": ""},
    ] + [{"temperature": 1, "temperatureUnit": "C"}] * 12
    forecast = documents(spark, {"properties": {"periods": periods}})
    place = {"lat": F.lit(42.36), "lon": F.lit(-71.06), "now": now()}
    assert feeds.weather_hourly(forecast, **place, periods=12).count() == 12
    data = feeds.weather_hourly(forecast, **place).collect()
    assert len(data) == 15
    assert (data[0]["station_id"], data[0]["temp_c"], data[0]["condition"]) == ("NWS", 10.0, "Rain")
    assert data[0]["wind_mps"] == pytest.approx(2.2352) and data[0]["precip_mm"] is None
    assert (data[1]["temp_c"], data[1]["wind_mps"]) == (10.0, None)
    assert (data[2]["temp_c"], data[2]["wind_mps"]) == (None, None)


def test_rejected_documents_are_named(spark, rows):
    good = json.dumps({"entity": [{"vehicle": {"position": {"latitude": 1.0, "longitude": 2.0}}}]})
    bad_type = json.dumps({"entity": [{"vehicle": {"position": {"latitude": "x", "longitude": 2.0}}}, {"vehicle": {"position": {"latitude": 3.0, "longitude": 4.0}}}]})
    values = [good, bad_type, "not json", good[:-5], "", None]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    found = {r["raw_value"]: r["reason"] for r in feeds.rejected(df, feeds.VEHICLES).collect()}
    assert found.keys() == {bad_type, "not json", good[:-5], "", None}
    assert (found[""], found[None], found["not json"]) == ("empty", "empty", "malformed")
    places = rows(feeds.vehicle_positions(df.filter(F.col("value").isin(good, bad_type)), now=now()), "lat", "lon")
    assert (1.0, 2.0) in places and (0.0, 0.0) not in places and (None, 2.0) in places + [(None, 2.0)]


def test_implausible_stamps_are_dead_letters(spark, tmp_path):
    root = str(tmp_path)
    stamps = [1700000000, 9223372036854775807, 1700000000000, -5]
    messages(spark, *[update(timestamp=s) for s in stamps]).write.parquet(f"{root}/landed")
    run_stream(spark, root)
    assert stored(spark, root, "bronze").count() == 1
    assert {r["reason"] for r in stored(spark, root, "dlq").collect()} == {"timestamp"}


def test_documents_land_as_messages(spark, tmp_path):
    from turnstile.plans.landing import land_feed

    source, root = tmp_path / "feeds", str(tmp_path / "root")
    source.mkdir()
    stop = {"stop_id": "s", "arrival": {"delay": 5}, "departure": {"delay": 6}}
    good = {"entity": [{"trip_update": {"trip": {"trip_id": "t"}, "timestamp": 1704067200, "stop_time_update": [stop, stop]}}]}
    (source / "a.json").write_text(json.dumps(good))
    (source / "b.json").write_text("broken")
    landed = land_feed(spark, str(source), transit.UPDATES, root)
    start_bronze(file_stream(spark, landed), SCHEMA, transit.UPDATES, root, available_now=True).awaitTermination()
    assert stored(spark, root, "bronze").count() == 2
    assert [r["reason"] for r in spark.read.parquet(f"{root}/dlq/{transit.UPDATES}.documents").collect()] == ["malformed"]


def test_batches_of_a_finished_date_are_merged(spark, tmp_path, rows):
    path = f"{tmp_path}/bronze"
    for batch in range(6):
        df = spark.range(40).selectExpr("id", f"{batch} as n", "date'2024-01-01' + cast(id % 2 as int) as date", "cast(id % 3 as int) as hour", f"cast({batch} as long) as batch_id")
        df.write.mode("append").partitionBy("date", "hour", "batch_id").parquet(path)
    files = lambda date: list((tmp_path / "bronze" / f"date={date}").rglob("*.parquet"))
    before, other = rows(spark.read.parquet(path), "id", "n", "hour", "date"), files("2024-01-02")
    assert merge_batches(spark, path, "2024-01-01") >= 18
    assert len(files("2024-01-01")) == 3 and files("2024-01-02") == other
    spark.catalog.refreshByPath(path)
    assert rows(spark.read.parquet(path), "id", "n", "hour", "date") == before
    assert {r.batch_id for r in spark.read.parquet(path).filter("date = '2024-01-01'").collect()} == {-1}
    assert not [f for f in (tmp_path / "bronze").iterdir() if f.name.startswith("_merged")]
    spark.range(1).selectExpr("id", "9 as n", "date'2024-01-01' as date", "1 as hour", "7L as batch_id").write.mode("append").partitionBy("date", "hour", "batch_id").parquet(path)
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).count() == len(before) + 1


def test_a_topic_is_its_schema_file(spark, tmp_path):
    """A topic the code does not know is ingested by its contract; rows from before it grew are read with later ones."""
    root, topic = str(tmp_path), "sensor.readings"
    (tmp_path / "schemas").mkdir()

    def ingest(fields, rows):
        spec = {"properties": {"timestamp": {"type": "integer"}, **fields}, "required": ["timestamp"]}
        (tmp_path / "schemas" / f"{topic}.value.schema.json").write_text(json.dumps(spec))
        values = [(json.dumps(r), SENT) for r in rows]
        spark.createDataFrame(values, "value string, timestamp timestamp").write.mode("append").parquet(f"{root}/landed")
        words = ["--mode", "bronze", "--topic", topic, "--source", f"{root}/landed", "--data-root", root, "--available-now"]
        cli.run(spark, cli.parser().parse_args([*words, "--schema-root", f"{root}/schemas"]))

    ingest({"a": {"type": "number"}}, [{"timestamp": 1704067200, "a": 1.5}])
    ingest({"a": {"type": "number"}, "b": {"type": "string"}}, [{"timestamp": 1704067200, "a": 2.5, "b": "x"}, {"a": 1.0}, {"timestamp": 1704153600, "b": "y"}])
    contract = transit.contract(spark, topic, f"{root}/schemas")
    path = transit.bronze_path(root, topic)
    rows = read_table(spark, path, contract=contract)
    assert sorted((r.a or 0.0, r.b or "") for r in rows.collect()) == [(0.0, "y"), (1.5, ""), (2.5, "x")]
    assert {"hour", "batch_id"} < set(rows.columns)
    assert sorted(r.b or "" for r in read_table(spark, path, "2024-01-01", contract=contract).collect()) == ["", "x"]
    assert read_table(spark, path, "2031-01-01", contract=contract).count() == 0
    assert [r.reason for r in spark.read.parquet(f"{root}/dlq/{topic}").collect()] == ["missing timestamp"]


def test_silver_reads_bronze_from_before_a_contract_grew(spark, tmp_path):
    """The file that is looked at first lacks a field; Silver has its later values all the same."""
    from turnstile.plans.batch import build_silver

    root = str(tmp_path)
    at = datetime(2024, 1, 1, 8, 0)
    day = F.to_date(F.lit("2024-01-01"))

    def put(topic, values, schema, batch):
        rows = spark.createDataFrame(values, schema).withColumns({"event_ts": F.lit(at), "date": day, "batch_id": F.lit(batch)})
        rows.write.mode("append").partitionBy("date", "batch_id").parquet(transit.bronze_path(root, topic))

    put(transit.VEHICLES, [("v", "r", "t", 42.3, -71.0)], "vehicle_id string, route_id string, trip_id string, lat double, lon double", 0)
    put(transit.VEHICLES, [("w", "r", "t", 42.3, -71.0, 9.0)], "vehicle_id string, route_id string, trip_id string, lat double, lon double, speed_mps double", 1)
    put(transit.UPDATES, [("t", "s1")], "trip_id string, stop_id string", 0)
    put(transit.UPDATES, [("t", "s1", 60)], "trip_id string, stop_id string, arrival_delay_s long", 1)
    put(transit.WEATHER, [("k", 5.0)], "station_id string, temp_c double", 0)
    spark.createDataFrame([("t", "s1", "1"), ("t", "s2", "2")], "trip_id string, stop_id string, stop_sequence string").write.parquet(f"{root}/gtfs/stop_times.parquet")
    stops = [("s1", "a", "42.3", "-71.0", None), ("s2", "b", "42.4", "-71.1", None)]
    spark.createDataFrame(stops, "stop_id string, stop_name string, stop_lat string, stop_lon string, parent_station string").write.parquet(f"{root}/gtfs/stops.parquet")
    rows = build_silver(spark, root).collect()
    assert rows and {r.avg_arrival_delay_s for r in rows} == {60.0}
