"""Silver: aggregates, sequences, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions.times import minute_of
from turnstile.operators.curate import fill_unknown, in_time_range, on_date, rename_role
from turnstile.operators.joins import hourly_means, join_hourly, join_role, next_in_sequence, parent_or_self
from turnstile.operators.silver import silver_facts
from turnstile.showcase.common import MINUTES, cents, events, minute_facts, query, seconds, table


@query(
    "silver_minute_agg",
    f"WITH {MINUTES} SELECT event_type, minute_s, active_users, avg_value, score AS crowding_score FROM scored",
)
def silver_minute_agg(spark, folder):
    facts = minute_facts(spark, folder)
    return facts.select("event_type", seconds("minute").alias("minute_s"), "active_users", "avg_value", F.col("score").alias("crowding_score"))


def next_types(spark, folder):
    return next_in_sequence(
        events(spark, folder).select("user_id", "event_id", "event_type", "ts"),
        ["user_id"],
        ["ts", "event_id"],
        "event_type",
        "next_type",
    )


NEXT_TYPES = """
nexts AS (
  SELECT user_id, event_id, event_type,
         lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type
  FROM events),
pairs AS (SELECT * FROM nexts WHERE next_type IS NOT NULL)
"""


@query("next_in_sequence", f"WITH {NEXT_TYPES} SELECT * FROM pairs")
def next_event(spark, folder):
    return next_types(spark, folder).select("user_id", "event_id", "event_type", "next_type")


@query(
    "next_in_sequence_sliced",
    """SELECT event_type, event_id, nxt FROM (
         SELECT *, lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt
         FROM (SELECT event_type, event_id, ts FROM events UNION ALL SELECT 'view', -1, TIMESTAMP '1970-01-01 00:00:00')) WHERE nxt IS NOT NULL""",
)
def next_event_sliced(spark, folder):
    """Every type is a hot key, and one has a row long before all others."""
    rows = events(spark, folder).select("event_type", "event_id", "ts")
    first = spark.sql("SELECT 'view' AS event_type, -1L AS event_id, TIMESTAMP '1970-01-01 00:00:00' AS ts")
    found = next_in_sequence(rows.unionByName(first), ["event_type"], ["ts", "event_id"], "event_id", "nxt", rows_per_slice=1000)
    return found.select("event_type", "event_id", "nxt")


@query(
    "next_in_sequence_by_text",
    """SELECT event_type, event_id, value, nxt FROM (
         SELECT *, lead(event_id) OVER (PARTITION BY event_type ORDER BY props, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL""",
)
def next_event_by_text(spark, folder):
    rows = events(spark, folder).select("event_type", "event_id", "value", "props")
    found = next_in_sequence(rows, ["event_type"], ["props", "event_id"], "event_id", "nxt", rows_per_slice=1000)
    return found.select("event_type", "event_id", "value", "nxt")


@query(
    "update_pairs_left",
    f"""WITH {NEXT_TYPES}
    SELECT e.user_id, e.event_id, e.value, p.next_type
    FROM events e LEFT JOIN pairs p ON e.user_id = p.user_id AND e.event_id = p.event_id""",
)
def update_pairs_left(spark, folder):
    pairs = next_types(spark, folder).select("user_id", "event_id", "next_type")
    updates = events(spark, folder).select("user_id", "event_id", "value")
    return updates.join(pairs, on=["user_id", "event_id"], how="left")


@query(
    "fanout_left",
    """SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(*) AS joined_rows, count(o_orderkey) AS orders,
              CAST(sum(CAST(round(o_totalprice * 1e2) AS BIGINT)) AS BIGINT) AS total_cents
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
)
def fanout_left(spark, folder):
    # Orders are added up per customer before the join, so no pair is built.
    orders = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("o_orderkey").alias("n"), F.sum(cents("o_totalprice")).alias("total"))
    )
    joined = table(spark, folder, "customer").select("c_custkey", "c_mktsegment").join(orders, on="c_custkey", how="left")
    return joined.groupBy("c_mktsegment").agg(
        F.count("c_custkey").alias("customers"),
        F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("joined_rows"),
        F.sum(F.coalesce("n", F.lit(0))).alias("orders"),
        F.sum("total").alias("total_cents"),
    )


@query(
    "bucket_weather_join",
    """WITH hourly AS (
         SELECT date_trunc('hour', ts) AS h, avg(CAST(round(value * 1e2) AS BIGINT)) AS mean_cents
         FROM events GROUP BY 1)
       SELECT event_id, event_type, mean_cents FROM events LEFT JOIN hourly ON date_trunc('hour', ts) = h""",
)
def bucket_weather_join(spark, folder):
    readings = events(spark, folder).select("ts", cents().alias("cents"))
    hourly = hourly_means(readings, "ts", {"cents": "mean_cents"})
    rows = events(spark, folder).select("event_id", "event_type", "ts")
    return join_hourly(rows, hourly, "ts").select("event_id", "event_type", "mean_cents")


@query(
    "two_role_dimension",
    """WITH places AS (
         SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 3 THEN r_name END AS parent
         FROM nation JOIN region ON n_regionkey = r_regionkey)
       SELECT coalesce(o.parent, o.n_name) AS origin, coalesce(d.parent, d.n_name) AS dest,
              count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
       LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
       LEFT JOIN places o ON c_nationkey = o.n_nationkey LEFT JOIN places d ON s_nationkey = d.n_nationkey
       GROUP BY 1, 2""",
)
def two_role_dimension(spark, folder):
    orders = rename_role(table(spark, folder, "orders"), {"o_orderkey": "l_orderkey", "o_custkey": "c_custkey"})
    regions = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    places = (
        table(spark, folder, "nation")
        .join(regions, on="n_regionkey")
        .select("n_nationkey", F.col("n_name").alias("stop_id"), F.when(F.col("n_regionkey") < 3, F.col("r_name")).alias("parent_station"))
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(orders, on="l_orderkey", how="left")
    lines = join_role(lines, table(spark, folder, "customer"), "c_custkey", "c_custkey", {"c_nationkey": "from_nation"})
    lines = join_role(lines, table(spark, folder, "supplier"), "l_suppkey", "s_suppkey", {"s_nationkey": "to_nation"})
    # One row per pair of nations before the two place joins.
    pairs = lines.groupBy("from_nation", "to_nation").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    pairs = join_role(pairs, places, "from_nation", "n_nationkey", {"stop_id": "origin"})
    pairs = join_role(pairs, places, "to_nation", "n_nationkey", {"stop_id": "dest"})
    placed = parent_or_self(parent_or_self(pairs, "origin", places), "dest", places)
    return placed.groupBy("origin", "dest").agg(F.sum("n").alias("lines"), F.sum("q").cast("long").alias("quantity"))


@query(
    "fill_unknown",
    """SELECT c_custkey, coalesce(s_name, 'unknown') AS s_name
       FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def fill_unknown_names(spark, folder):
    joined = join_role(table(spark, folder, "customer"), table(spark, folder, "supplier"), "c_custkey", "s_suppkey", {"s_name": "s_name"})
    return fill_unknown(joined, ["s_name"]).select("c_custkey", "s_name")


@query(
    "date_pruned_scan",
    """SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM events
       WHERE CAST(ts AS DATE) = DATE '2024-01-15'
         AND ts >= TIMESTAMP '2024-01-15 06:00:00' AND ts <= TIMESTAMP '2024-01-15 18:00:00'""",
)
def date_pruned_scan(spark, folder):
    rows = in_time_range(events(spark, folder), "ts", "2024-01-15 06:00:00", "2024-01-15 18:00:00")
    rows = on_date(rows.withColumn("date", F.to_date("ts")), "date", "2024-01-15")
    return rows.select("event_id", "event_type", seconds().alias("ts_s"))


def silver_inputs(spark, folder):
    """Events in the parts of positions, updates, weather and schedule."""
    rows = events(spark, folder).withColumn("trip_id", F.concat(F.lit("t"), F.col("user_id")))
    positions = rows.select(
        "trip_id",
        (F.lit(42.0) + F.col("user_id") % 10 / 100.0).alias("lat"),
        F.when(F.col("event_id") % 11 != 0, F.lit(-71.0) - F.col("event_id") % 3 / 100.0).alias("lon"),
        F.col("ts").alias("event_ts"),
    )
    updates = rows.select(
        "trip_id",
        F.col("event_type").alias("stop_id"),
        F.round("value").cast("long").alias("arrival_delay_s"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 60).alias("departure_delay_s"),
        F.col("ts").alias("event_ts"),
    )
    weather = rows.select(
        F.col("ts").alias("event_ts"),
        F.round("value").alias("temp_c"),
        F.col("user_id").cast("double").alias("wind_mps"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5).cast("double").alias("precip_mm"),
    )
    # Sequence numbers are text, as in schedule files.
    stop_times = rows.groupBy("trip_id", F.col("event_type").alias("stop_id")).agg(F.min("event_id").cast("string").alias("stop_sequence"))
    stops = rows.select(F.col("event_type").alias("stop_id")).distinct()
    stops = stops.withColumn("parent_station", F.when(F.col("stop_id").isin("view", "click"), F.lit("place-browse")))
    return positions, updates, weather, stop_times, stops


SILVER_INPUTS = """
rows_ AS (SELECT *, concat('t', user_id) AS trip_id FROM events),
pos AS (
  SELECT trip_id, CAST(42.0 AS DOUBLE) + user_id % 10 / 1e2 AS lat,
         CASE WHEN event_id % 11 <> 0 THEN CAST(-71.0 AS DOUBLE) - event_id % 3 / 1e2 END AS lon,
         date_trunc('minute', ts) AS minute FROM rows_),
upd AS (
  SELECT trip_id, event_type AS stop_id, CAST(round(value) AS DOUBLE) AS arr,
         CAST(CASE WHEN event_id % 4 <> 0 THEN event_id % 60 END AS DOUBLE) AS dep FROM rows_),
wx AS (
  SELECT date_trunc('hour', ts) AS hr, avg(round(value)) AS avg_temp_c, avg(CAST(user_id AS DOUBLE)) AS avg_wind_speed,
         avg(CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS DOUBLE)) AS avg_precip_mm FROM rows_ GROUP BY 1),
seq AS (SELECT trip_id, event_type AS stop_id, min(event_id) AS n FROM rows_ GROUP BY 1, 2),
pairs AS (SELECT * FROM (
  SELECT trip_id, stop_id, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY n) AS dest_stop FROM seq)
  WHERE dest_stop IS NOT NULL),
stops AS (
  SELECT DISTINCT event_type AS stop_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'place-browse' END AS parent FROM events)
"""

HEX = """
hexed AS (
  SELECT *, 6371.0088e0 * cos(radians(42.36e0)) * (lon * (pi() / 180)) AS x,
         6371.0088e0 / cos(radians(42.36e0)) * sin(lat * (pi() / 180)) AS y,
         sqrt(2 * 0.737e0 / (3 * sqrt(3e0))) AS a FROM pos),
axial AS (SELECT *, x * sqrt(3e0) / (3 * a) - y / (3 * a) AS q, y * 2 / (3 * a) AS r FROM hexed),
cubed AS (
  SELECT *, floor(q + 0.5e0) AS cq, floor(r + 0.5e0) AS cr, floor(-q - r + 0.5e0) AS cs FROM axial),
errs AS (SELECT *, abs(cq - q) AS dq, abs(cr - r) AS dr, abs(cs + q + r) AS ds FROM cubed),
celled AS (
  SELECT *, CASE WHEN lat IS NULL OR lon IS NULL THEN NULL ELSE concat('r8:',
    CAST(CASE WHEN dq > dr AND dq > ds THEN -cr - cs ELSE cq END AS BIGINT), ':',
    CAST(CASE WHEN dr >= dq AND dr > ds THEN -cq - cs ELSE cr END AS BIGINT)) END AS h3 FROM errs)
"""


@query(
    "silver_job",
    f"""WITH {SILVER_INPUTS}, {HEX},
    joined AS (
      SELECT c.trip_id, c.h3, c.minute, u.arr, u.dep,
             coalesce(so.parent, u.stop_id, 'unknown') AS origin_stop,
             coalesce(sd.parent, p.dest_stop, 'unknown') AS dest_stop
      FROM celled c LEFT JOIN upd u ON c.trip_id = u.trip_id
      LEFT JOIN pairs p ON u.trip_id = p.trip_id AND u.stop_id = p.stop_id
      LEFT JOIN stops so ON u.stop_id = so.stop_id LEFT JOIN stops sd ON p.dest_stop = sd.stop_id),
    facts AS (
      SELECT origin_stop, dest_stop, h3, minute, count(DISTINCT trip_id) AS active_trips,
             sum(arr) / count(arr) AS avg_arrival_delay_s,
             sum(dep) / nullif(count(dep), 0) AS avg_departure_delay_s
      FROM joined GROUP BY 1, 2, 3, 4)
    SELECT origin_stop, dest_stop, h3, CAST(floor(epoch(minute)) AS BIGINT) AS minute_s, active_trips,
           avg_arrival_delay_s, avg_departure_delay_s, avg_temp_c, avg_wind_speed, avg_precip_mm,
           coalesce(avg_arrival_delay_s, 0) + active_trips * 1e-1 AS crowding_score,
           strftime(minute, '%Y-%m-%d') AS day
    FROM facts LEFT JOIN wx ON date_trunc('hour', minute) = hr""",
)
def silver_job(spark, folder):
    facts = silver_facts(*silver_inputs(spark, folder))
    return facts.select(
        "origin_stop",
        "dest_stop",
        "h3",
        seconds("minute").alias("minute_s"),
        "active_trips",
        "avg_arrival_delay_s",
        "avg_departure_delay_s",
        "avg_temp_c",
        "avg_wind_speed",
        "avg_precip_mm",
        "crowding_score",
        F.date_format("minute", "yyyy-MM-dd").alias("day"),
    )


@query(
    "minute_truncation",
    """SELECT event_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute_s,
              CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s FROM events""",
)
def minute_truncation(spark, folder):
    rows = events(spark, folder).withColumn("minute", minute_of(F.col("ts"))).withColumn("hour", F.date_trunc("hour", "ts"))
    return rows.select("event_id", seconds("minute").alias("minute_s"), seconds("hour").alias("hour_s"))
