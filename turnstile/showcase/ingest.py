"""Decoding, splitting, feeds and scalar columns."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from turnstile.functions import times, units, values
from turnstile.operators.curate import cast_numbers, expand_struct, publishable
from turnstile.plans import transit
from turnstile.session import work_path
from turnstile.showcase.common import ORACLES, events, query, seconds, table
from turnstile.sources import feeds
from turnstile.sources.feature_log import batch_counts
from turnstile.sources.json_schema import struct_type
from turnstile.sources.tables import read_table
from turnstile.sources.topics import dead_letters, decode, file_stream, split_messages
from turnstile.streaming.bronze import start_bronze

PROPS = struct_type({"properties": {"k": {"type": "integer"}}, "required": ["k"]})
EVENT = struct_type(
    {
        "properties": {
            "id": {"type": "integer"},
            "kind": {"type": "string"},
            "value": {"type": ["number", "null"]},
            "timestamp": {"type": ["integer", "null"]},
        },
        "required": ["id", "kind"],
    }
)


def as_messages(rows, value):
    return rows.select("event_id", "event_type", value.alias("value"), F.col("ts").alias("timestamp"))


@query("json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark, folder):
    payload = F.from_json("props", PROPS).alias("payload")
    return expand_struct(events(spark, folder).select("event_id", payload), "payload", ["event_id"]).select("event_id", "k")


def damaged():
    """The row as a JSON message; six in seven kinds of id give a broken one."""
    good = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("kind"),
            F.col("value"),
            seconds().alias("timestamp"),
        )
    )
    kind = F.col("event_id") % 49
    return (
        F.when(kind == 0, F.lit("not json"))
        .when(kind == 7, F.lit("  "))
        .when(kind == 14, F.lit(None).cast("string"))
        .when(kind == 21, F.lit("[]"))
        .when(kind == 28, F.concat(F.lit('{"id": "x", "kind": "'), "event_type", F.lit('"}')))
        .when(kind == 35, F.concat(F.lit('{"id": '), "event_id", F.lit("}")))
        .when(kind == 43, F.concat(F.lit('{"id": 1, "kind": "far", "timestamp": 9223372036854775807}')))
        .when(kind == 44, F.concat(F.lit('{"id": 1, "kind": "ms", "timestamp": '), seconds() * 1000, F.lit("}")))
        .when(kind == 42, F.concat(F.lit('{"id": '), "event_id", F.lit(', "kind": "late", "extra": 1}')))
        .otherwise(good)
    )


DAMAGED = """
sent AS (
  SELECT *, CASE event_id % 49
    WHEN 0 THEN 'not json' WHEN 7 THEN '  ' WHEN 14 THEN NULL WHEN 21 THEN '[]'
    WHEN 28 THEN concat('{"id": "x", "kind": "', event_type, '"}')
    WHEN 35 THEN concat('{"id": ', event_id, '}')
    WHEN 42 THEN concat('{"id": ', event_id, ', "kind": "late", "extra": 1}')
    WHEN 43 THEN '{"id": 1, "kind": "far", "timestamp": 9223372036854775807}'
    WHEN 44 THEN concat('{"id": 1, "kind": "ms", "timestamp": ', CAST(floor(epoch(ts)) AS BIGINT) * 1000, '}')
    ELSE CAST(json_object('id', event_id, 'kind', event_type, 'value', value,
                          'timestamp', CAST(floor(epoch(ts)) AS BIGINT)) AS VARCHAR) END AS msg
  FROM events),
judged AS (
  SELECT *, CASE
    WHEN msg IS NULL OR trim(msg) = '' THEN 'empty'
    WHEN NOT json_valid(msg) OR json_type(msg) <> 'OBJECT' THEN 'malformed'
    WHEN json_type(msg, '$.id') = 'VARCHAR' THEN 'type'
    WHEN json_type(msg, '$.id') IS NULL THEN 'missing id'
    WHEN json_type(msg, '$.kind') IS NULL THEN 'missing kind'
    WHEN CAST(json_extract(msg, '$.timestamp') AS BIGINT) NOT BETWEEN 0 AND 4102444800 THEN 'timestamp' END AS reason
  FROM sent)
"""


@query(
    "bad_row_split",
    f"WITH {DAMAGED} SELECT event_type, coalesce(reason, 'good') AS reason, count(*) AS n FROM judged GROUP BY 1, 2",
)
def bad_row_split(spark, folder):
    messages = events(spark, folder).select("event_type", damaged().alias("value"), F.col("ts").alias("timestamp"))
    # ``decode`` keeps the envelope only, so the type rides along as broker time.
    tagged = messages.select("value", F.struct("event_type").alias("timestamp"))
    judged = decode(tagged, EVENT)
    return judged.groupBy(F.col("kafka_ts.event_type").alias("event_type"), F.coalesce("reason", F.lit("good")).alias("reason")).agg(
        F.count("*").alias("n")
    )


@query(
    "dead_letter_rows",
    f"WITH {DAMAGED} SELECT msg AS raw_value, reason, 'events' AS topic, CAST(floor(epoch(ts)) AS BIGINT) AS sent_s FROM judged WHERE reason IS NOT NULL",
)
def dead_letter_rows(spark, folder):
    _, bad = split_messages(decode(as_messages(events(spark, folder), damaged()), EVENT))
    return dead_letters(bad, "events").select("raw_value", "reason", "topic", seconds("kafka_ts").alias("sent_s"))


@query(
    "event_time_fallback",
    """WITH t AS (
         SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 2 HOUR
                ELSE date_trunc('second', ts) END AS e FROM events)
       SELECT event_id, CAST(floor(epoch(e)) AS BIGINT) AS event_s, strftime(e, '%Y-%m-%d') AS day, strftime(e, '%H') AS hour FROM t""",
)
def event_time_fallback(spark, folder):
    rows = events(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, seconds()).alias("timestamp"),
        (F.col("ts") + F.expr("interval 2 hours")).alias("kafka_ts"),
    )
    rows = rows.withColumn("event_ts", times.event_time(F.col("timestamp"), F.col("kafka_ts")))
    return rows.select(
        "event_id",
        seconds("event_ts").alias("event_s"),
        F.date_format(F.to_date("event_ts"), "yyyy-MM-dd").alias("day"),
        times.hour_string(F.col("event_ts")).alias("hour"),
    )


@query(
    "feature_key_roundtrip",
    """WITH k AS (SELECT event_id, concat_ws(':', event_type, CAST(user_id AS VARCHAR), CAST(event_id % 3 * 10 AS VARCHAR)) AS key FROM events)
       SELECT event_id, key, split_part(key, ':', 1) AS origin_stop, split_part(key, ':', 2) AS dest_stop,
              CAST(split_part(key, ':', 3) AS INTEGER) AS horizon_min FROM k""",
)
def feature_key_roundtrip(spark, folder):
    key = values.feature_key(F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id") % 3 * 10)
    rows = events(spark, folder).select("event_id", key.alias("key"))
    return rows.withColumns(values.split_feature_key(F.col("key")))


@query(
    "payload_json",
    "SELECT event_id, value AS rolling_mean_7d, CASE WHEN event_id % 3 <> 0 THEN value * 2 END AS hist_p50, event_type AS h3 FROM events",
)
def payload_json(spark, folder):
    text = values.to_payload(
        rolling_mean_7d=F.col("value"), hist_p50=F.when(F.col("event_id") % 3 != 0, F.col("value") * 2), h3=F.col("event_type")
    )
    rows = events(spark, folder).select("event_id", text.alias("data"))
    back = values.from_payload(F.col("data"), "rolling_mean_7d double, hist_p50 double, h3 string")
    return rows.select("event_id", back.alias("p")).select("event_id", "p.*")


@query("minute_of_day", "SELECT event_id, hour(ts) * 60 + minute(ts) AS minute_of_day, strftime(ts, '%H') AS hour FROM events")
def minute_of_day(spark, folder):
    ts = F.col("ts")
    return events(spark, folder).select(
        "event_id", times.minute_of_day(ts).cast("long").alias("minute_of_day"), times.hour_string(ts).alias("hour")
    )


WIND = """CASE event_id % 4 WHEN 0 THEN concat(event_id % 30, ' mph') WHEN 1 THEN concat(event_id % 30, ' to ', event_id % 30 + 5, ' mph')
          WHEN 2 THEN 'calm' ELSE '' END"""


def wind_text():
    n = F.col("event_id") % 30
    kind = F.col("event_id") % 4
    return (
        F.when(kind == 0, F.concat(n, F.lit(" mph")))
        .when(kind == 1, F.concat(n, F.lit(" to "), n + 5, F.lit(" mph")))
        .when(kind == 2, "calm")
        .otherwise("")
    )


UNIT = "CASE event_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'C' END"


def unit_text():
    return F.when(F.col("event_id") % 3 == 0, "f").when(F.col("event_id") % 3 == 1, "C")


@query(
    "unit_conversions",
    f"""SELECT event_id, CASE WHEN upper({UNIT}) = 'F' THEN (value - 32e0) * 5e0 / 9e0 ELSE value END AS temp_c,
               TRY_CAST(split_part({WIND}, ' ', 1) AS DOUBLE) * 0.44704e0 AS wind_mps FROM events""",
)
def unit_conversions(spark, folder):
    return events(spark, folder).select(
        "event_id",
        units.to_celsius(F.col("value"), unit_text()).alias("temp_c"),
        units.wind_speed_mps(wind_text()).alias("wind_mps"),
    )


def absent_when(condition, value):
    """to_json leaves null fields out."""
    return F.when(~condition, value)


@query(
    "flatten_updates",
    " UNION ALL ".join(
        f"""SELECT CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('t', user_id) END AS trip_id, 's{i}' AS stop_id,
            CASE WHEN (event_id + {i}) % 4 = 0 THEN 0 ELSE event_id % 100 + {i} END AS arrival_delay_s,
            CAST({i} AS BIGINT) AS departure_delay_s,
            CASE WHEN event_id % 6 = 0 THEN 1700000000 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS timestamp FROM events"""
        for i in (1, 2, 3)
    ),
)
def flatten_updates(spark, folder):
    e = F.col("event_id")

    def stop(i):
        delay = absent_when((e + i) % 4 == 0, F.struct((e % 100 + i).alias("delay")))
        return F.struct(F.lit(f"s{i}").alias("stop_id"), delay.alias("arrival"), F.struct(F.lit(i).alias("delay")).alias("departure"))

    update = F.struct(
        F.struct(absent_when(e % 9 == 0, F.concat(F.lit("t"), "user_id")).alias("trip_id")).alias("trip"),
        F.when(e % 6 != 0, seconds()).otherwise(0).alias("timestamp"),
        F.array(*[stop(i) for i in (1, 2, 3)]).alias("stop_time_update"),
    )
    documents = events(spark, folder).select(
        F.to_json(F.struct(F.array(F.struct(update.alias("trip_update"))).alias("entity"))).alias("value")
    )
    return feeds.trip_updates(documents, now=F.lit(1700000000).cast("long"))


@query(
    "flatten_vehicles",
    """SELECT CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('v', user_id) END AS vehicle_id, concat('t', event_id) AS trip_id,
              event_type AS route_id, CAST(42 AS DOUBLE) + user_id % 10 / 1e1 AS lat, CAST(-71 AS DOUBLE) AS lon,
              CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS speed_mps,
              CASE WHEN event_id % 6 = 0 THEN 1700000000 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS timestamp
       FROM events WHERE event_id % 7 <> 0""",
)
def flatten_vehicles(spark, folder):
    e = F.col("event_id")
    position = F.struct(
        (F.lit(42.0) + F.col("user_id") % 10 / 10.0).alias("latitude"),
        F.lit(-71.0).alias("longitude"),
        absent_when(e % 3 == 0, F.col("value")).alias("speed"),
    )
    vehicle = F.struct(
        F.struct(absent_when(e % 10 == 0, F.concat(F.lit("v"), "user_id")).alias("id")).alias("vehicle"),
        F.struct(F.concat(F.lit("t"), e).alias("trip_id"), F.col("event_type").alias("route_id")).alias("trip"),
        absent_when(e % 7 == 0, position).alias("position"),
        absent_when(e % 6 == 0, seconds()).alias("timestamp"),
    )
    # One entity per feed has no position, another is no vehicle at all.
    other = F.struct(F.lit(None).cast(vehicle_type()).alias("vehicle"))
    documents = events(spark, folder).select(
        F.to_json(F.struct(F.array(F.struct(vehicle.alias("vehicle")), other).alias("entity"))).alias("value")
    )
    return feeds.vehicle_positions(documents, now=F.lit(1700000000).cast("long"))


def vehicle_type() -> str:
    return (
        "struct<vehicle:struct<id:string>,trip:struct<trip_id:string,route_id:string>,"
        "position:struct<latitude:double,longitude:double,speed:double>,timestamp:bigint>"
    )


@query(
    "flatten_forecast",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NWS' ELSE 'us' END AS station_id,
              CASE WHEN (c_custkey + i) % 2 = 0 THEN (CAST(i + 30 AS DOUBLE) - 32e0) * 5e0 / 9e0 ELSE CAST(i + 30 AS DOUBLE) END AS temp_c,
              CASE WHEN i % 5 = 0 THEN NULL ELSE CAST(i AS DOUBLE) * 0.44704e0 END AS wind_mps,
              c_mktsegment AS condition
       FROM customer, range(1, 15) r(i)""",
)
def flatten_forecast(spark, folder, periods=None):
    key = F.col("c_custkey")

    def period(i):
        return F.struct(
            (i + 30).cast("double").alias("temperature"),
            F.when((key + i) % 2 == 0, "F").alias("temperatureUnit"),
            F.when(i % 5 == 0, "calm").otherwise(F.concat(i.cast("string"), F.lit(" to 40 mph"))).alias("windSpeed"),
            F.col("c_mktsegment").alias("shortForecast"),
        )

    properties = F.struct(
        absent_when(key % 4 == 0, F.lit("us")).alias("units"), F.transform(F.sequence(F.lit(1), F.lit(14)), period).alias("periods")
    )
    documents = table(spark, folder, "customer").select("c_custkey", F.to_json(F.struct(properties.alias("properties"))).alias("value"))
    rows = feeds.weather_hourly(documents, lat=F.col("c_custkey").cast("double"), now=F.lit(0).cast("long"), periods=periods)
    return rows.select(F.col("lat").cast("long").alias("c_custkey"), "station_id", "temp_c", "wind_mps", "condition")


@query("flatten_forecast_12_periods", ORACLES["flatten_forecast"].replace("range(1, 15)", "range(1, 13)"))
def flatten_forecast_12_periods(spark, folder):
    return flatten_forecast(spark, folder, 12)


@query(
    "feed_rejects",
    """SELECT CASE event_id % 5 WHEN 1 THEN 'not json' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE
         concat('{"entity": [{"vehicle": {"position": {"latitude": "', event_type, '"}}}]}') END AS raw_value,
         CASE event_id % 5 WHEN 1 THEN 'malformed' WHEN 4 THEN 'type' ELSE 'empty' END AS reason, count(*) AS n
       FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2""",
)
def feed_rejects(spark, folder):
    kind = F.col("event_id") % 5
    value = (
        F.when(kind == 0, '{"entity": []}')
        .when(kind == 1, "not json")
        .when(kind == 2, "")
        .when(kind == 4, F.concat(F.lit('{"entity": [{"vehicle": {"position": {"latitude": "'), "event_type", F.lit('"}}}]}')))
    )
    found = feeds.rejected(events(spark, folder).select(value.alias("value")), feeds.VEHICLES)
    return found.groupBy("raw_value", "reason").agg(F.count("*").alias("n"))


MIXED = """CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE concat(event_id % 100, '.25') END"""


def mixed_text():
    kind = F.col("event_id") % 4
    return (
        F.when(kind == 0, F.col("event_id").cast("string"))
        .when(kind == 1, "n/a")
        .when(kind == 2, "")
        .otherwise(F.concat(F.col("event_id") % 100, F.lit(".25")))
    )


@query(
    "coerce_numeric",
    f"""WITH m AS (SELECT event_id, {MIXED} AS raw FROM events)
        SELECT event_id, TRY_CAST(raw AS DOUBLE) AS number, CASE WHEN TRY_CAST(raw AS DOUBLE) IS NULL THEN raw END AS text,
               coalesce(TRY_CAST(raw AS DOUBLE), 0) AS filled FROM m""",
)
def coerce_numeric(spark, folder):
    rows = events(spark, folder).select("event_id", mixed_text().alias("raw"))
    number, text = values.number_and_text(F.col("raw"))
    return rows.select("event_id", number.alias("number"), text.alias("text"), values.number_or_zero(F.col("raw")).alias("filled"))


@query(
    "casts_and_epoch",
    f"""SELECT event_id, TRY_CAST({MIXED} AS DOUBLE) AS number, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
               strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d%H%M%S') AS version FROM events""",
)
def casts_and_epoch(spark, folder):
    rows = events(spark, folder).select("event_id", mixed_text().alias("number"), "ts")
    return cast_numbers(rows, ["number"]).select(
        "event_id",
        "number",
        seconds().alias("ts_s"),
        F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"),
        times.version_stamp(F.col("ts")).alias("version"),
    )


@query(
    "publish_payload",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 0) AS rolling_mean_7d,
              CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' ELSE event_type END AS h3 FROM events""",
)
def publish_payload(spark, folder):
    kind = F.col("event_id") % 4
    rows = events(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("rolling_mean_7d"),
        F.when(kind == 1, "").when(kind > 1, F.col("event_type")).alias("h3"),
    )
    return publishable(rows, ["rolling_mean_7d"], ["h3"])


@query(
    "batch_counts",
    """SELECT event_type, count(*) AS received, count(*) FILTER (WHERE event_id % 8 <> 0) AS wrote,
              count(*) FILTER (WHERE event_id % 8 = 0) AS errors FROM events GROUP BY 1""",
)
def counts_per_batch(spark, folder):
    key = F.when(F.col("event_id") % 8 != 0, F.col("user_id"))
    return events(spark, folder).groupBy("event_type").agg(*batch_counts(key.isNotNull()))


@query(
    "stream_ingest",
    f"""WITH {DAMAGED}
    SELECT event_id AS id, json_extract_string(msg, '$.kind') AS kind, CAST(json_extract(msg, '$.value') AS DOUBLE) AS value,
           CAST(floor(epoch(ts)) AS BIGINT) AS event_s, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour
    FROM judged WHERE reason IS NULL""",
)
def stream_ingest(spark, folder):
    root = work_path(spark, "ingest")
    as_messages(events(spark, folder), damaged()).select("value", "timestamp").write.parquet(f"{root}/landed")
    start_bronze(file_stream(spark, f"{root}/landed"), EVENT, "events", root, dead_letter=True, available_now=True).awaitTermination()
    return read_table(spark, f"{root}/bronze/events").select(
        "id",
        "kind",
        "value",
        seconds("event_ts").alias("event_s"),
        F.date_format("date", "yyyy-MM-dd").alias("day"),
        F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour"),
    )


@query(
    "dead_letter_table",
    f"WITH {DAMAGED} SELECT msg AS raw_value, reason, 'events' AS topic, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2",
)
def dead_letter_table(spark, folder):
    """The dead letters that the ingest wrote, read back."""
    root = work_path(spark, "letters")
    as_messages(events(spark, folder), damaged()).select("value", "timestamp").write.parquet(f"{root}/landed")
    start_bronze(file_stream(spark, f"{root}/landed"), EVENT, "events", root, dead_letter=True, available_now=True).awaitTermination()
    return read_table(spark, f"{root}/dlq/events").groupBy("raw_value", "reason", "topic").agg(F.count("*").alias("n"))


@query(
    "stream_late_rows",
    f"""WITH {DAMAGED} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS late
        FROM judged WHERE reason IS NULL GROUP BY 1""",
)
def stream_late_rows(spark, folder):
    root = work_path(spark, "late")
    messages = as_messages(events(spark, folder), damaged())
    late = F.col("event_id") % 3 == 0
    # Two rounds of one stream: the second brings rows of dates already stored.
    for rows in (messages.filter(~late), messages.filter(late)):
        rows.select("value", "timestamp").write.mode("append").parquet(f"{root}/landed")
        start_bronze(file_stream(spark, f"{root}/landed"), EVENT, "events", root, dead_letter=False, available_now=True).awaitTermination()
    stored = read_table(spark, f"{root}/bronze/events")
    return stored.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("id") % 3 == 0).alias("late")
    )


# Two versions of a topic's contract, as its schema file: the second adds a field.
READING = {
    "type": "object",
    "properties": {"id": {"type": "integer"}, "kind": {"type": "string"}, "timestamp": {"type": "integer"}},
    "required": ["id", "timestamp"],
}
GROWN = READING | {"properties": READING["properties"] | {"value": {"type": ["number", "null"]}}}


def put_contract(spark, folder: str, topic: str, spec: dict) -> None:
    lines = spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1)
    lines.write.mode("overwrite").text(f"{folder}/{topic}.value.schema.json")


@query(
    "evolving_topic",
    """SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 2 = 1 THEN value END AS value,
              CAST(floor(epoch(ts)) AS BIGINT) AS event_s, strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def evolving_topic(spark, folder):
    """A topic known by its schema file alone, whose contract grows between two rounds of one stream."""
    root, topic = work_path(spark, "evolving"), "events.readings"
    columns = [F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value", seconds().alias("timestamp")]
    messages = events(spark, folder).select((F.col("event_id") % 2 == 1).alias("later"), F.to_json(F.struct(*columns)).alias("value"), F.col("ts").alias("timestamp"))
    for spec, rows in ((READING, messages.filter("not later")), (GROWN, messages.filter("later"))):
        put_contract(spark, f"{root}/schemas", topic, spec)
        rows.select("value", "timestamp").write.mode("append").parquet(f"{root}/landed")
        schema = transit.contract(spark, topic, f"{root}/schemas")
        start_bronze(file_stream(spark, f"{root}/landed"), schema, topic, root, dead_letter=True, available_now=True).awaitTermination()
    stored = read_table(spark, transit.bronze_path(root, topic), contract=transit.contract(spark, topic, f"{root}/schemas"))
    return stored.select("id", "kind", "value", seconds("event_ts").alias("event_s"), F.date_format("date", "yyyy-MM-dd").alias("day"))
