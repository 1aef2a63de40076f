"""Feature log, look-ups and the station rollup."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnstile.functions import cells, display, units, values
from turnstile.operators import serving
from turnstile.operators.features import (
    DEFAULTS,
    FEATURES,
    children_of,
    fresh_rows,
    lookup,
    lookup_with_rollup,
    ranked_children,
    rollup_requests,
)
from turnstile.operators.joins import add_names, name_to_id, named_stations, resolve_ids
from turnstile.plans.prediction import check_requests, predict_batch
from turnstile.sources.feature_log import compact_log, read_snapshot, write_batch

MINUTE = datetime(2024, 1, 1)
GOLD = "origin_stop string, dest_stop string, horizon_min int, minute timestamp, h3 string, rolling_mean_7d double"
SNAPSHOT = "origin_stop string, dest_stop string, horizon_min int, " + ", ".join(f"{f} double" for f in FEATURES) + ", h3 string"


def gold(spark, *data):
    return spark.createDataFrame([(o, d, 10, MINUTE + timedelta(minutes=m), h, v) for o, d, m, h, v in data], GOLD)


def test_log_keeps_the_newest_row_per_key(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    counts = write_batch(gold(spark, ("a", "b", 1, "x", 1.0), ("a", "b", 2, "x", 2.0), ("c", "d", 1, "x", 3.0), (None, "d", 1, "x", 9.0)), 0, path)
    assert counts == {"received": 4, "wrote": 3, "errors": 1}
    late = gold(spark, ("a", "b", 1, "x", 7.0), ("c", "d", 1, "x", 4.0))
    for _ in range(2):  # the second run is a replay
        assert write_batch(late, 1, path)["wrote"] == 2
    want = [("a", "b", 2.0), ("c", "d", 4.0)]
    assert rows(read_snapshot(spark, path), "origin_stop", "dest_stop", "rolling_mean_7d") == want
    assert spark.read.parquet(path).count() == 4
    compact_log(spark, path, f"{path}-2")
    assert spark.read.parquet(f"{path}-2").count() == 2
    write_batch(gold(spark, ("a", "b", 3, "x", 8.0)), 2, f"{path}-2")
    assert rows(read_snapshot(spark, f"{path}-2"), "rolling_mean_7d") == [(4.0,), (8.0,)]


def test_equal_minutes_are_ordered_by_cell(spark, tmp_path):
    path = str(tmp_path / "log")
    write_batch(gold(spark, ("a", "b", 1, "y", 1.0), ("a", "b", 1, "x", 2.0)), 0, path)
    assert read_snapshot(spark, path).first()["rolling_mean_7d"] == 1.0


def test_time_to_live(spark):
    df = spark.createDataFrame([(1, MINUTE), (2, MINUTE + timedelta(seconds=200))], "id int, updated_at timestamp")
    now = F.lit("2024-01-01 00:05:01").cast("timestamp")
    assert [r["id"] for r in fresh_rows(df, "updated_at", 300, now).collect()] == [2]
    assert fresh_rows(df, "updated_at", 0, now).count() == 2


def test_lookup_tells_zero_from_missing(spark):
    snapshot = spark.createDataFrame([("a", "b", 10, 5.0)], "origin_stop string, dest_stop string, horizon_min int, rolling_mean_7d double")
    asked = spark.createDataFrame([("a", "b", 10), ("a", "b", 20)], "origin_stop string, dest_stop string, horizon_min int")
    got = {r["horizon_min"]: r for r in lookup(asked, snapshot).collect()}
    assert (got[10]["rolling_mean_7d"], got[10]["hist_p50"], got[10]["h3"], got[10]["found"]) == (5.0, 0.0, "unknown", True)
    assert (got[20]["rolling_mean_7d"], got[20]["found"]) == (0.0, False)


def test_platforms_come_first(spark, rows):
    stops = spark.createDataFrame(
        [(s, "place-p") for s in ("door-1", "70001", "7", "70002-x", "a", "12")] + [("z", None), ("y", ""), (None, "place-p"), ("", "place-p")],
        "stop_id string, parent_station string",
    )
    ranked = ranked_children(children_of(stops)).orderBy("rank")
    assert [r["child"] for r in ranked.collect()] == ["12", "7", "70001", "70002-x", "a", "door-1"]
    assert ranked_children(children_of(stops), 2).count() == 2


def by_hand(asked, snapshot, children, limit):
    """The rollup as loops over child pairs."""
    answers = {}
    for origin, dest, horizon in asked:
        if not (origin.startswith("place-") or dest.startswith("place-")):
            continue
        pairs = [(o, d) for o in children.get(origin, [origin]) for d in children.get(dest, [dest])]
        hits = [snapshot[(o, d, horizon)] for o, d in pairs[:limit] if (o, d, horizon) in snapshot]
        if not hits:
            continue
        means = []
        for i in range(len(FEATURES)):
            known = [h[i] for h in hits if h[i] is not None]
            means.append(sum(known) / len(known) if known else 0.0)
        cell = next((h[-1] for h in hits if h[-1] not in (None, "", "unknown")), "unknown")
        answers[(origin, dest, horizon)] = (*means, cell)
    return answers


@pytest.mark.parametrize("limit", [1, 4, 11, 500, None])
def test_rollup_equals_loops_over_pairs(spark, limit):
    draw = random.Random(5)
    stops, children = [], {}
    for p in range(4):
        ids = [f"7{p}{i:03d}" if i % 3 else f"door-{p}-{i}" for i in range(draw.randint(1, 6))]
        stops += [(s, f"place-{p}") for s in ids]
        children[f"place-{p}"] = sorted(ids, key=lambda s: (not s[0] == "7", s))
    stops += [("lone", None)]
    everything = [s for s, _ in stops] + ["place-0", "elsewhere"]
    snapshot = {}
    for o in everything:
        for d in everything:
            if draw.random() < 0.4:
                numbers = [draw.choice([None, float(draw.randrange(64))]) for _ in FEATURES]
                snapshot[(o, d, 10)] = (*numbers, draw.choice([None, "", "unknown", f"c{draw.randrange(9)}"]))
    asked = [(o, d, 10) for o in [*children, "lone"] for d in [*children, "lone", "place-none"]]
    got = rollup_requests(
        spark.createDataFrame(asked, "origin_stop string, dest_stop string, horizon_min int"),
        spark.createDataFrame([(*k, *v) for k, v in snapshot.items()], SNAPSHOT),
        children_of(spark.createDataFrame(stops, "stop_id string, parent_station string")),
        max_combinations=limit,
    )
    mine = {(r["origin_stop"], r["dest_stop"], r["horizon_min"]): tuple(r[f] for f in (*FEATURES, "h3")) for r in got.collect()}
    want = by_hand(asked, snapshot, children, limit)
    assert mine.keys() == want.keys()
    for key, row in want.items():
        assert mine[key] == pytest.approx(row)


def feature_rows(spark, *data):
    return spark.createDataFrame([(o, d, h, 1.0, 2.0, m, m, m, "c") for o, d, h, m in data], SNAPSHOT)


def test_direct_hit_beats_rollup(spark):
    stops = spark.createDataFrame([("s1", "place-a"), ("s2", "place-a")], "stop_id string, parent_station string")
    snapshot = feature_rows(spark, ("place-a", "x", 10, 9.0), ("s1", "x", 10, 1.0), ("s1", "x", 20, 1.0), ("s2", "x", 20, 4.0))
    asked = spark.createDataFrame(
        [(1, "place-a", "x", 10), (2, "place-a", "x", 20), (3, "place-a", "y", 20), (4, "s1", "x", 30), (2, "place-a", "x", 20)],
        "id int, origin_stop string, dest_stop string, horizon_min int",
    )
    got = [(r["id"], r["source"], r["rolling_mean_7d"]) for r in lookup_with_rollup(asked, snapshot, children_of(stops)).orderBy("id").collect()]
    assert got == [(1, "direct", 9.0), (2, "children", 2.5), (2, "children", 2.5), (3, "default", 0.0), (4, "default", 0.0)]


def test_names_and_ids(spark):
    stops = spark.createDataFrame(
        [("place-a", "Alewife"), ("place-b", "Braintree"), ("70001", "Alewife"), (None, "x")], "stop_id string, stop_name string"
    )
    stations = named_stations(stops)
    assert stations.count() == 2
    asked = spark.createDataFrame([(1, "place-a"), (2, "aleWIFE"), (3, "70001"), (4, "nowhere"), (5, None)], "id int, stop string")
    got = add_names(resolve_ids(name_to_id(asked, "stop", "named", stations), "stop", stations), "stop", "name", stations)
    assert [(r["id"], r["stop"], r["name"], r["named"]) for r in got.orderBy("id").collect()] == [
        (1, "place-a", "Alewife", None),
        (2, "place-a", "Alewife", "place-a"),
        (3, "70001", "70001", None),
        (4, "nowhere", "nowhere", None),
        (5, None, None, None),
    ]
    names = [r["stop_name"] for r in serving.sorted_by_name(stations, "stop_name").collect()]
    assert names == ["Alewife", "Braintree"]


def test_predictions_without_a_model(spark):
    stops = spark.createDataFrame([("place-a", "Alewife", None), ("s1", "one", "place-a")], "stop_id string, stop_name string, parent_station string")
    asked = spark.createDataFrame(
        [(1, "alewife", "x", 10), (2, "s1", "x", 10), (3, "s1", "x", 4), (4, "s1", "x", 121), (5, None, "x", 10), (6, "s1", "x", None)],
        "id int, origin_stop string, dest_stop string, horizon_min int",
    )
    good, bad = check_requests(asked)
    assert sorted(r["id"] for r in bad.collect()) == [3, 4, 5, 6]
    snapshot = feature_rows(spark, ("s1", "x", 10, 5.0))
    got = predict_batch(good, snapshot, named_stations(stops), children_of(stops), now=F.lit("2024-01-01 01:05:00").cast("timestamp"))
    data = [(r["id"], r["origin_stop"], r["origin_name"], r["dest_name"], r["p50"], r["p90"], r["p10"]) for r in got.orderBy("id").collect()]
    assert data == [(1, "place-a", "Alewife", "x", 5.0, 6.0, None), (2, "s1", "s1", "x", 5.0, 6.0, None)]


def test_response_fallbacks(spark):
    df = spark.createDataFrame([(1, None, 2.0, None, 1.0), (2, None, None, None, None)], "id int, p50 double, mean double, p90 double, p10 double")
    got = serving.shape_predictions(df, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2.0, 0.0, 1.0, None), (2, 0.0, 0.0, None, None)]


def test_map_points(spark):
    df = spark.createDataFrame(
        [("a", "b", 10, "r8:0:0", 0.5, None, None), ("c", "d", 10, None, None, 0.1, 0.3)],
        "origin_stop string, dest_stop string, horizon_min int, h3 string, rolling_mean_7d double, hist_p50 double, hist_p90 double",
    )
    first, second = serving.map_points(df).orderBy("origin_stop").collect()
    assert (first["p50"], first["p90"], first["level"], first["radius"]) == (0.5, 0.6, "High", 600.0)
    assert (first["lat"], first["lon"]) == (0.0, 0.0)
    assert (second["h3"], second["level"], second["colour"]) == ("unknown", "Moderate", "#f59e0b")
    assert (second["lat"], second["lon"]) == cells.DEFAULT_CENTRE


def test_recent_points(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, t int")
    got = serving.recent_points(df, ["k"], ["t"], 20).collect()
    assert [r["t"] for r in got if r["k"] == "a"] == list(range(30, 50)) and len(got) == 21


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_levels_and_units(spark):
    scores = [F.lit(x) for x in (0.0, 0.25, 0.5, 0.75)]
    assert one(spark, *[display.crowding_level(s) for s in scores]) == ("Low", "Moderate", "High", "Very High")
    assert one(spark, *[display.crowding_rgba(s)[0] for s in scores]) == (16, 245, 249, 239)
    assert one(spark, display.gauge_position(F.lit(1.5)), display.percent(F.lit(0.345))) == (98.0, 35)
    assert one(spark, units.wind_speed_mps(F.lit("10 mph")), units.to_celsius(F.lit(212), F.lit("F"))) == (pytest.approx(4.4704), 100.0)


def test_keys_and_text(spark):
    parts = values.split_feature_key(values.feature_key(F.lit("a"), F.lit("b"), F.lit(10)))
    assert one(spark, *parts.values()) == ("a", "b", 10)
    platform = [values.is_platform(F.lit(s)) for s in ("70001", "7", "70001-x", "7000-x", "door", "")]
    assert one(spark, *platform, values.is_platform(F.lit(None).cast("string"))) == (True, True, True, False, False, False, False)
    assert one(spark, values.same_text(F.lit("aB"), F.lit("Ab"))) == (True,)
    assert one(spark, *values.number_and_text(F.lit("1.5")), *values.number_and_text(F.lit("x"))) == (1.5, None, None, "x")


def test_cells(spark):
    points = [(42.36 + i / 137, -71.06 + i / 91) for i in range(-40, 40)]
    df = spark.createDataFrame(points, "lat double, lon double").withColumn("cell", cells.hex_cell(F.col("lat"), F.col("lon")))
    lat, lon = cells.cell_centre(F.col("cell"))
    for r in df.withColumns({"clat": lat, "clon": lon}).collect():
        north = (r["lat"] - r["clat"]) * 111.2
        east = (r["lon"] - r["clon"]) * 111.2 * 0.739
        assert (north**2 + east**2) ** 0.5 <= cells.cell_side_km(8) * 1.01
    nothing = F.lit(None).cast("double")
    assert one(spark, cells.hex_cell(nothing, F.lit(1.0)), *cells.cell_centre(F.lit("junk"))) == (None, *cells.DEFAULT_CENTRE)
    with pytest.raises(ValueError):
        cells.spatial_cell(nothing, nothing, backend="square")


def test_defaults_cover_all_features():
    assert set(DEFAULTS) == {*FEATURES, "h3"}


def test_rewritten_gold_reaches_the_snapshot(spark, tmp_path):
    """A Gold partition that is overwritten streams its new files."""
    from turnstile.plans import transit
    from turnstile.sources.tables import overwrite_partitions
    from turnstile.streaming.materialize import published_columns, start_materializer, table_stream

    root = str(tmp_path)
    rows = feature_rows(spark, ("a", "b", 10, 1.0), ("a", "b", 20, 2.0)).withColumn("minute", F.lit(MINUTE))
    counts = []

    def publish():
        stream = published_columns(table_stream(spark, transit.gold_path(root)))
        start_materializer(
            stream, f"{root}/log", f"{root}/checkpoint", on_counts=lambda batch, c: counts.append((batch, c["wrote"])), available_now=True
        ).awaitTermination()
        return {r["horizon_min"]: (r["rolling_mean_7d"], r["active_trips"]) for r in read_snapshot(spark, f"{root}/log").collect()}

    overwrite_partitions(rows, transit.gold_path(root), ["horizon_min"])
    assert publish() == {10: (1.0, 1.0), 20: (2.0, 1.0)}
    later = rows.filter("horizon_min = 20").withColumn("rolling_mean_7d", F.lit(9.0))
    overwrite_partitions(later, transit.gold_path(root), ["horizon_min"])
    assert publish() == {10: (1.0, 1.0), 20: (9.0, 1.0)}
    assert publish() == {10: (1.0, 1.0), 20: (9.0, 1.0)}
    assert counts == [(0, 2), (1, 1)]
