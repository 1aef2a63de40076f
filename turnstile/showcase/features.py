"""Snapshots, look-ups, hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions import cells, display, values
from turnstile.operators import serving
from turnstile.operators.features import (
    FEATURES,
    KEY,
    children_of,
    fresh_rows,
    latest_per_key,
    lookup,
    ranked_children,
    rollup_requests,
)
from turnstile.operators.joins import add_names, name_to_id, named_stations, resolve_ids
from turnstile.plans.prediction import check_requests, predict_batch
from turnstile.session import work_path
from turnstile.showcase.common import MINUTES, events, minute_facts, query, seconds, table
from turnstile.sources.feature_log import read_snapshot
from turnstile.streaming.keyed_state import read_state, start_keyed_state
from turnstile.streaming.materialize import start_materializer, table_stream

LATEST = """
latest AS (SELECT * FROM (
  SELECT user_id, event_type, event_id, value, ts,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)
"""
LAST_COLUMNS = ["user_id", "event_type", "event_id", "value"]


def latest_events(spark, folder):
    return latest_per_key(events(spark, folder), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value", "ts"])


@query("latest_per_key", f"WITH {LATEST} SELECT user_id, event_type, event_id, value FROM latest")
def latest_key(spark, folder):
    return latest_events(spark, folder).select(LAST_COLUMNS)


@query("stream_materialize", f"WITH {LATEST} SELECT user_id, event_type, event_id, value FROM latest")
def stream_materialize(spark, folder):
    root = work_path(spark, "materialize")
    rows = events(spark, folder).select("user_id", "event_type", "event_id", "value", "ts")
    rows.repartition(4).write.parquet(f"{root}/table")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    stream = table_stream(spark, f"{root}/table", max_files=2)
    start_materializer(stream, f"{root}/log", f"{root}/checkpoint", keys=keys, order=order, available_now=True).awaitTermination()
    return read_snapshot(spark, f"{root}/log", keys, order).select(LAST_COLUMNS)


def keyed_events(spark, folder, ttl_seconds, max_files=None):
    """Events through the stream's keyed state: (checkpoint, folder of expired rows)."""
    root = work_path(spark, "keyed")
    rows = events(spark, folder).select(*LAST_COLUMNS, "ts")
    rows.repartition(4).write.parquet(f"{root}/table")
    start_keyed_state(
        table_stream(spark, f"{root}/table", max_files=max_files), f"{root}/checkpoint", f"{root}/expired",
        keys=["user_id", "event_type"], order=["ts", "event_id"], stamp="ts", ttl_seconds=ttl_seconds, available_now=True,
    ).awaitTermination()
    return f"{root}/checkpoint", f"{root}/expired"


@query("stream_keyed_state", f"WITH {LATEST} SELECT user_id, event_type, event_id, value FROM latest")
def stream_keyed_state(spark, folder):
    """The snapshot of ``stream_materialize`` out of the state of a stream, over several batches."""
    checkpoint, _ = keyed_events(spark, folder, 0, max_files=2)
    return read_state(spark, checkpoint, ["user_id", "event_type"], stamp="ts").select(LAST_COLUMNS)


@query(
    "keyed_state_ttl",
    f"""WITH {LATEST} SELECT user_id, event_type, event_id, value FROM latest
        WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def keyed_state_ttl(spark, folder):
    """Keys alive at the time of the last row, out of a state with a time to live of a day."""
    checkpoint, _ = keyed_events(spark, folder, 86400, max_files=2)
    now = F.lit(events(spark, folder).agg(F.max("ts")).first()[0])
    return read_state(spark, checkpoint, ["user_id", "event_type"], stamp="ts", ttl_seconds=86400, now=now).select(LAST_COLUMNS)


@query(
    "keyed_state_expired",
    """WITH gaps AS (
         SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) + INTERVAL 6 HOUR, TRUE) AS fresh FROM events),
       lives AS (
         SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM gaps),
       ends AS (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type, life ORDER BY ts DESC, event_id DESC) AS n FROM lives)
       SELECT user_id, event_type, event_id, value FROM ends
       WHERE n = 1 AND ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""",
)
def keyed_state_expired(spark, folder):
    """The last row of each key's life that has ended, keys living six hours after each row."""
    _, expired = keyed_events(spark, folder, 6 * 3600)
    return spark.read.parquet(expired).select(LAST_COLUMNS)


@query(
    "ttl_snapshot",
    f"WITH {LATEST} SELECT user_id, event_type, event_id, value FROM latest WHERE ts > TIMESTAMP '2024-01-29 00:00:00'",
)
def ttl_snapshot(spark, folder):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return fresh_rows(latest_events(spark, folder), "ts", 86400, now).select(LAST_COLUMNS)


@query(
    "lookup_defaults",
    f"""WITH {LATEST}, asked AS (
          SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'error' END AS event_type FROM customer)
        SELECT a.user_id, a.event_type, coalesce(value, 0) AS value, coalesce(event_id, -1) AS event_id, l.event_id IS NOT NULL AS found
        FROM asked a LEFT JOIN latest l ON a.user_id = l.user_id AND a.event_type = l.event_type""",
)
def lookup_defaults(spark, folder):
    kind = F.col("c_custkey") % 3
    asked = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(kind == 0, "view").when(kind == 1, "click").otherwise("error").alias("event_type")
    )
    return lookup(asked, latest_events(spark, folder), ["user_id", "event_type"], {"value": 0.0, "event_id": -1})


# Regions stand in for stations and nations for their stops. Half of the stops
# have platform numbers; every line is a trip from the customer's to the
# supplier's nation.
STOPS = """
stops AS (
  SELECT CASE WHEN n_nationkey % 2 = 0 THEN CAST(70000 + n_nationkey AS VARCHAR) ELSE concat('door-', n_nationkey) END AS stop_id,
         n_nationkey, concat('place-', r_name) AS parent FROM nation JOIN region ON n_regionkey = r_regionkey)
"""
SNAPSHOT = f"""
{STOPS},
snap AS (
  SELECT o.stop_id AS origin_stop, d.stop_id AS dest_stop, CAST(l_linenumber % 2 * 10 + 10 AS INTEGER) AS horizon_min,
         CAST(count(*) AS DOUBLE) AS active_trips, sum(l_quantity) AS avg_departure_delay_s, max(l_quantity) AS rolling_mean_7d,
         CASE WHEN count(*) % 3 <> 0 THEN min(l_quantity) END AS hist_p50, CAST(max(l_partkey) AS DOUBLE) AS hist_p90,
         CASE WHEN count(*) % 4 = 0 THEN 'unknown' ELSE concat('c', min(l_suppkey)) END AS h3
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN stops o ON c_nationkey = o.n_nationkey JOIN stops d ON s_nationkey = d.n_nationkey
  GROUP BY 1, 2, 3)
"""


def stop_table(spark, folder):
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.when(key % 2 == 0, (key + 70000).cast("string")).otherwise(F.concat(F.lit("door-"), key)).alias("stop_id"),
        F.concat(F.lit("place-"), "r_name").alias("parent_station"),
        key,
        F.col("n_name").alias("stop_name"),
    )


def station_table(spark, folder):
    return table(spark, folder, "region").select(F.concat(F.lit("place-"), "r_name").alias("stop_id"), F.col("r_name").alias("stop_name"))


def trip_snapshot(spark, folder):
    stops = stop_table(spark, folder)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("origin"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dest"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_suppkey",
        "l_partkey",
        "l_quantity",
        (F.col("l_linenumber") % 2 * 10 + 10).cast("int").alias("horizon_min"),
    )
    lines = lines.join(orders, on="o_orderkey").join(customers, on="o_custkey").join(suppliers, on="l_suppkey")
    n = F.count("*")
    snapshot = lines.groupBy("origin", "dest", "horizon_min").agg(
        n.cast("double").alias("active_trips"),
        F.sum("l_quantity").alias("avg_departure_delay_s"),
        F.max("l_quantity").alias("rolling_mean_7d"),
        F.when(n % 3 != 0, F.min("l_quantity")).alias("hist_p50"),
        F.max("l_partkey").cast("double").alias("hist_p90"),
        F.when(n % 4 == 0, "unknown").otherwise(F.concat(F.lit("c"), F.min("l_suppkey"))).alias("h3"),
    )
    origin = stops.select(F.col("n_nationkey").alias("origin"), F.col("stop_id").alias("origin_stop"))
    dest = stops.select(F.col("n_nationkey").alias("dest"), F.col("stop_id").alias("dest_stop"))
    return snapshot.join(origin, on="origin").join(dest, on="dest").select(*KEY, *FEATURES, "h3")


# Every stored trip is asked for between its stations, and between its
# origin's station and its own last stop.
ASKED = """
asked AS (
  SELECT DISTINCT o.parent AS origin_stop, CASE WHEN ends = 0 THEN d.parent ELSE s.dest_stop END AS dest_stop, horizon_min
  FROM snap s JOIN stops o ON s.origin_stop = o.stop_id JOIN stops d ON s.dest_stop = d.stop_id, range(0, 2) r(ends))
"""


def asked_requests(spark, folder, snapshot):
    up = stop_table(spark, folder).select(F.col("stop_id"), F.col("parent_station"))
    rows = snapshot.select(*KEY).join(up.toDF("origin_stop", "from_station"), on="origin_stop").join(up.toDF("dest_stop", "to_station"), on="dest_stop")
    ends = F.explode(F.array("to_station", "dest_stop"))
    return rows.select(F.col("from_station").alias("origin_stop"), ends.alias("dest_stop"), "horizon_min").distinct()


def rollup_sql(limit: int | None) -> str:
    kept = "" if limit is None else f"WHERE place <= {limit}"
    left = "" if limit is None else f", CAST(greatest(max(n_pairs) - {limit}, 0) AS BIGINT) AS pairs_left_out"
    return f"""WITH {SNAPSHOT}, {ASKED},
    ranked AS (
      SELECT parent, stop_id, row_number() OVER (PARTITION BY parent
        ORDER BY CASE WHEN regexp_full_match(stop_id, '[0-9]+') OR regexp_matches(stop_id, '^7[0-9]{{4}}') THEN 0 ELSE 1 END, stop_id) AS n
      FROM stops),
    kids AS (SELECT parent AS stop, stop_id AS child, n FROM ranked UNION ALL SELECT stop_id, stop_id, 1 FROM stops),
    combos AS (
      SELECT a.*, o.child AS oc, d.child AS dc,
             row_number() OVER (PARTITION BY a.origin_stop, a.dest_stop, a.horizon_min ORDER BY o.n, d.n) AS place,
             count(*) OVER (PARTITION BY a.origin_stop, a.dest_stop, a.horizon_min) AS n_pairs
      FROM asked a JOIN kids o ON a.origin_stop = o.stop JOIN kids d ON a.dest_stop = d.stop),
    hits AS (
      SELECT c.origin_stop, c.dest_stop, c.horizon_min, place, n_pairs, active_trips, avg_departure_delay_s, rolling_mean_7d, hist_p50, hist_p90, h3
      FROM (SELECT * FROM combos {kept}) c
      JOIN snap s ON c.oc = s.origin_stop AND c.dc = s.dest_stop AND c.horizon_min = s.horizon_min)
    SELECT origin_stop, dest_stop, horizon_min, avg(active_trips) AS active_trips, avg(avg_departure_delay_s) AS avg_departure_delay_s,
           avg(rolling_mean_7d) AS rolling_mean_7d, coalesce(avg(hist_p50), 0) AS hist_p50, avg(hist_p90) AS hist_p90,
           coalesce(arg_min(h3, place) FILTER (WHERE h3 <> 'unknown'), 'unknown') AS h3{left}
    FROM hits GROUP BY 1, 2, 3"""


def rollup(spark, folder, limit):
    snapshot = trip_snapshot(spark, folder)
    children = children_of(stop_table(spark, folder))
    return rollup_requests(asked_requests(spark, folder, snapshot), snapshot, children, max_combinations=limit)


@query("child_rollup", rollup_sql(None))
def child_rollup(spark, folder):
    snapshot = trip_snapshot(spark, folder)
    return rollup_requests(asked_requests(spark, folder, snapshot), snapshot, children_of(stop_table(spark, folder)))


@query("child_rollup_500_pairs", rollup_sql(500))
def child_rollup_500_pairs(spark, folder):
    return rollup(spark, folder, 500)


@query("child_rollup_first_pairs", rollup_sql(7))
def child_rollup_first_pairs(spark, folder):
    return rollup(spark, folder, 7)


@query("child_rollup_all_pairs", rollup_sql(None))
def child_rollup_all_pairs(spark, folder):
    return rollup(spark, folder, None)


@query(
    "ranked_children",
    """WITH kids AS (
         SELECT concat('place-', c_nationkey) AS parent,
                CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN concat('7', c_custkey % 10, '001-', c_custkey)
                ELSE concat('door-', c_custkey) END AS child FROM customer WHERE c_custkey % 50 <> 49),
       ranked AS (
         SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY
           CASE WHEN regexp_full_match(child, '[0-9]+') OR regexp_matches(child, '^7[0-9]{4}') THEN 0 ELSE 1 END, child) AS INTEGER) AS rank FROM kids)
       SELECT * FROM ranked WHERE rank <= 40""",
)
def children_by_rank(spark, folder):
    key = F.col("c_custkey")
    stop = (
        F.when(key % 3 == 0, key.cast("string"))
        .when(key % 3 == 1, F.concat(F.lit("7"), key % 10, F.lit("001-"), key))
        .otherwise(F.concat(F.lit("door-"), key))
    )
    # Some stops have no parent station and are nobody's children.
    parent = F.when(key % 50 != 49, F.concat(F.lit("place-"), "c_nationkey"))
    return ranked_children(children_of(table(spark, folder, "customer").select(stop.alias("stop_id"), parent.alias("parent_station"))), 40)


@query(
    "resolve_id_or_name",
    """WITH names AS (SELECT concat('N', n_nationkey) AS id, n_name FROM nation),
       asked AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('N', c_nationkey) WHEN 1 THEN lower(concat('NATION_', c_nationkey))
                 ELSE c_name END AS raw FROM customer)
       SELECT c_custkey, coalesce(i.id, n.id, raw) AS stop, coalesce(j.n_name, coalesce(i.id, n.id, raw)) AS name, n.id AS by_name
       FROM asked LEFT JOIN names i ON raw = i.id LEFT JOIN names n ON lower(raw) = lower(n.n_name)
       LEFT JOIN names j ON coalesce(i.id, n.id, raw) = j.id""",
)
def resolve_id_or_name(spark, folder):
    names = table(spark, folder, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("stop_id"), F.col("n_name").alias("stop_name"))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    raw = (
        F.when(key % 3 == 0, F.concat(F.lit("N"), nation))
        .when(key % 3 == 1, F.concat(F.lit("nation_"), nation))
        .otherwise(F.col("c_name"))
    )
    asked = table(spark, folder, "customer").select("c_custkey", raw.alias("stop"))
    found = resolve_ids(name_to_id(asked, "stop", "by_name", names), "stop", names)
    return add_names(found, "stop", "name", names).select("c_custkey", "stop", "name", "by_name")


@query(
    "stops_sorted",
    """SELECT concat('place-', c_custkey) AS stop_id, c_name AS stop_name FROM customer
       WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY 2, 1""",
)
def stops_sorted(spark, folder):
    # Two segments stand for stations, the others for stops without the prefix.
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "place-").otherwise("node-")
    stops = table(spark, folder, "customer").select(F.concat(kind, "c_custkey").alias("stop_id"), F.col("c_name").alias("stop_name"))
    return serving.sorted_by_name(named_stations(stops), "stop_name", "stop_id")


POINTS = """
points AS (
  SELECT user_id, event_type, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 1e2 END, 0) AS rolling_mean,
         CASE WHEN event_id % 3 <> 0 THEN value / 2e2 END AS p50_, CASE WHEN event_id % 5 <> 0 THEN value / 5e1 END AS p90_ FROM latest),
shown AS (SELECT *, coalesce(p50_, rolling_mean) AS p50, coalesce(p90_, rolling_mean * 1.2e0) AS p90 FROM points)
"""


def point_snapshot(spark, folder):
    e, v = F.col("event_id"), F.col("value")
    return latest_events(spark, folder).select(
        "user_id",
        "event_type",
        F.when(e % 4 != 0, v / 100.0).alias("rolling_mean_7d"),
        F.when(e % 3 != 0, v / 200.0).alias("hist_p50"),
        F.when(e % 5 != 0, v / 50.0).alias("hist_p90"),
        F.when(e % 2 == 0, F.lit("r8:1:2")).alias("h3"),
    )


@query(
    "map_points",
    f"""WITH {LATEST}, {POINTS} SELECT user_id, event_type, rolling_mean, p50, p90, 300e0 + p90 * 500e0 AS radius,
        CASE WHEN p90 < 0.25 THEN 'Low' WHEN p90 < 0.5 THEN 'Moderate' WHEN p90 < 0.75 THEN 'High' ELSE 'Very High' END AS level,
        CASE WHEN p90 < 0.25 THEN '#10b981' WHEN p90 < 0.5 THEN '#f59e0b' WHEN p90 < 0.75 THEN '#f97316' ELSE '#ef4444' END AS colour
        FROM shown""",
)
def map_points(spark, folder):
    points = serving.map_points(point_snapshot(spark, folder), ["user_id", "event_type"], centres=False)
    return points.drop("h3")


@query(
    "display_columns",
    f"""WITH {LATEST}, {POINTS} SELECT user_id, event_type, CAST(round(p50 * 1e2) AS BIGINT) AS percent, least(p90 * 1e2, 98e0) AS gauge,
        regexp_full_match(CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE concat('u', user_id) END, '[0-9]+') AS numeric_id
        FROM shown""",
)
def display_columns(spark, folder):
    points = serving.map_points(point_snapshot(spark, folder), ["user_id", "event_type"], centres=False)
    text = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("u"), "user_id"))
    return points.select(
        "user_id",
        "event_type",
        display.percent(F.col("p50")).alias("percent"),
        display.gauge_position(F.col("p90")).alias("gauge"),
        values.is_numeric_id(text).alias("numeric_id"),
    )


@query(
    "recent_points",
    """SELECT event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20""",
)
def recent_points(spark, folder):
    return serving.recent_points(events(spark, folder), ["event_type"], ["ts", "event_id"], 20).select("event_type", "event_id", "value")


@query(
    "fallback_scores",
    f"WITH {MINUTES} SELECT event_type, minute_s, coalesce(avg_value, 0) AS p50, coalesce(avg_value, 0) * 1.2e0 AS p90, "
    "CAST(NULL AS DOUBLE) AS p10, CAST(NULL AS DOUBLE) AS p95 FROM scored",
)
def fallback_scores(spark, folder):
    scored = serving.fallback_scores(minute_facts(spark, folder), "avg_value").withColumn("minute_s", seconds("minute"))
    return serving.shape_predictions(scored, ["event_type", "minute_s"])


LAT_LON = """
pos AS (
  SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN CAST(42.0 AS DOUBLE) + user_id % 1000 / 1e3 END AS lat,
         CAST(-71.5 AS DOUBLE) + event_id % 777 / 1e3 AS lon FROM events)
"""


def placed_events(spark, folder):
    lat = F.when(F.col("event_id") % 13 != 0, F.lit(42.0) + F.col("user_id") % 1000 / 1000.0)
    return events(spark, folder).select("event_id", lat.alias("lat"), (F.lit(-71.5) + F.col("event_id") % 777 / 1000.0).alias("lon"))


def _hex_sql() -> str:
    from turnstile.showcase.silver import HEX

    return HEX


@query("hex_cells", f"WITH {LAT_LON}, {_hex_sql()} SELECT h3 AS cell, count(*) AS n FROM celled GROUP BY 1")
def hex_cells(spark, folder):
    cell = cells.spatial_cell(F.col("lat"), F.col("lon"), 8)
    return placed_events(spark, folder).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query(
    "cell_centres",
    f"""WITH {LAT_LON}, {_hex_sql()}, parts AS (
          SELECT event_id, h3, a, CAST(split_part(h3, ':', 2) AS DOUBLE) AS cq, CAST(split_part(h3, ':', 3) AS DOUBLE) AS cr
          FROM (SELECT event_id, h3, a FROM celled)),
        flat AS (SELECT *, cr * 3 * a / 2 AS y FROM parts)
        SELECT event_id, coalesce(round(degrees(asin(y * cos(radians(42.36e0)) / 6371.0088e0)), 6), 42.3601e0) AS lat,
               coalesce(round(degrees((cq + y / (3 * a)) * 3 * a / sqrt(3e0) / (6371.0088e0 * cos(radians(42.36e0)))), 6), -71.0589e0) AS lon
        FROM flat""",
)
def cell_centres(spark, folder):
    lat, lon = cells.cell_centre(cells.hex_cell(F.col("lat"), F.col("lon"), 8))
    return placed_events(spark, folder).select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(
    "request_validation",
    """SELECT c_custkey, concat('s', c_nationkey) AS origin_stop, c_mktsegment AS dest_stop, CAST(c_custkey % 151 AS INTEGER) AS horizon_min,
              c_custkey % 151 BETWEEN 5 AND 120 AS valid FROM customer""",
)
def request_validation(spark, folder):
    requests = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("s"), "c_nationkey").alias("origin_stop"),
        F.col("c_mktsegment").alias("dest_stop"),
        (F.col("c_custkey") % 151).cast("int").alias("horizon_min"),
    )
    good, bad = check_requests(requests)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query(
    "predict_batch",
    f"""WITH {SNAPSHOT}, reqs AS (
          SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(r_name) WHEN 1 THEN concat('place-', r_name)
                   ELSE CASE WHEN n_nationkey % 2 = 0 THEN CAST(70000 + n_nationkey AS VARCHAR) ELSE concat('door-', n_nationkey) END END AS o_raw,
                 CASE WHEN c_custkey % 5 = 0 THEN 'nowhere' ELSE CASE WHEN n_nationkey % 2 = 0 THEN CAST(70000 + n_nationkey AS VARCHAR)
                   ELSE concat('door-', n_nationkey) END END AS dest_stop,
                 CAST(c_custkey % 3 * 10 + 10 AS INTEGER) AS horizon_min
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        resolved AS (
          SELECT c_custkey, coalesce('place-' || r_name, o_raw) AS origin_stop, dest_stop, horizon_min
          FROM reqs LEFT JOIN region ON lower(o_raw) = lower(r_name)),
        means AS (
          SELECT o.parent AS origin_stop, s.dest_stop, s.horizon_min, avg(rolling_mean_7d) AS m
          FROM snap s JOIN stops o ON s.origin_stop = o.stop_id GROUP BY 1, 2, 3),
        answered AS (
          SELECT r.*, coalesce(s.rolling_mean_7d, m.m, 0) AS base,
                 CASE WHEN s.h3 IS NOT NULL THEN 'direct' WHEN m.m IS NOT NULL THEN 'children' ELSE 'default' END AS source
          FROM resolved r
          LEFT JOIN snap s ON r.origin_stop = s.origin_stop AND r.dest_stop = s.dest_stop AND r.horizon_min = s.horizon_min
          LEFT JOIN means m ON r.origin_stop = m.origin_stop AND r.dest_stop = m.dest_stop AND r.horizon_min = m.horizon_min)
        SELECT c_custkey, origin_stop, dest_stop, horizon_min, coalesce(r_name, origin_stop) AS origin_name, dest_stop AS dest_name, source,
               base AS p50, base * 1.2e0 AS p90, CAST(NULL AS DOUBLE) AS p10, CAST(NULL AS DOUBLE) AS p95
        FROM answered LEFT JOIN region ON origin_stop = concat('place-', r_name)""",
)
def predictions(spark, folder):
    stops = stop_table(spark, folder)
    key = F.col("c_custkey")
    own = stops.withColumnRenamed("n_nationkey", "c_nationkey")
    requests = (
        table(spark, folder, "customer")
        .join(own, on="c_nationkey")
        .select(
            "c_custkey",
            F.when(key % 3 == 0, F.lower(F.regexp_replace("parent_station", "^place-", "")))
            .when(key % 3 == 1, F.col("parent_station"))
            .otherwise(F.col("stop_id"))
            .alias("origin_stop"),
            F.when(key % 5 == 0, "nowhere").otherwise(F.col("stop_id")).alias("dest_stop"),
            (key % 3 * 10 + 10).cast("int").alias("horizon_min"),
        )
    )
    return predict_batch(requests, trip_snapshot(spark, folder), station_table(spark, folder), children_of(stops))
