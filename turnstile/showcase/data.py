"""Training data, quality, tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from turnstile.functions.times import version_stamp
from turnstile.operators import quality, registry
from turnstile.operators.boosting import BoostingParams, fit_quantile, fit_quantiles, score
from turnstile.operators.curate import pick_features
from turnstile.operators.dataset import add_series_id, add_time_index, encoder_windows, feature_matrix, ordered_split, training_features, training_rows
from turnstile.operators.joins import next_in_sequence
from turnstile.operators.halving import halving_search
from turnstile.operators.metrics import evaluate
from turnstile.operators.quality import between, not_null
from turnstile.plans.batch import validate_tables
from turnstile.plans.training import TrainingConfig, run_training
from turnstile.session import work_path
from turnstile.showcase.common import MINUTES, ORACLES, cents, events, minute_facts, query, seconds, table
from turnstile.showcase.gold import GOLD, gold_rows
from turnstile.sources.tables import cluster, compact, csv_to_parquet, overwrite_partitions, read_dimension, read_table, write_checked


def checks():
    return [
        quality.not_null("value"),
        quality.between("value", 0.0, 100.0),
        quality.between("user_id", low=0),
        quality.more_rows_than(0),
    ]


@query(
    "quality_suite",
    " UNION ALL ".join(
        f"SELECT 'events' AS table_name, '{name}' AS check_name, '{column}' AS column_name, count(*) AS row_count, {failed} AS failed, {ok} AS success FROM events"
        for name, column, failed, ok in (
            ("not_null", "value", "count(*) FILTER (WHERE value IS NULL)", "count(*) FILTER (WHERE value IS NULL) = 0"),
            ("between", "value", "count(*) FILTER (WHERE value < 0 OR value > 100)", "count(*) FILTER (WHERE value < 0 OR value > 100) = 0"),
            ("between", "user_id", "count(*) FILTER (WHERE user_id < 0)", "count(*) FILTER (WHERE user_id < 0) = 0"),
            ("more_rows_than", "*", "CAST(0 AS BIGINT)", "count(*) > 0"),
        )
    ),
)
def quality_suite(spark, folder):
    return quality.run_checks(events(spark, folder), "events", checks())


@query(
    "quarantined_rows",
    "SELECT event_id, value BETWEEN 0 AND 100 AS good FROM events",
)
def quarantined_rows(spark, folder):
    good, bad = quality.quarantine(events(spark, folder), checks())
    return good.select("event_id", F.lit(True).alias("good")).unionByName(bad.select("event_id", F.lit(False).alias("good")))


@query(
    "validate_job",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 'more_rows_than' AS check_name, '*' AS column_name, count(*) AS row_count, CAST(0 AS BIGINT) AS failed, count(*) > 0 AS success FROM {t}"
        for t in ("events", "lineitem")
    ),
)
def validate_job(spark, folder):
    return validate_tables(spark, {t: f"{folder}/{t}.parquet" for t in ("events", "lineitem")})


def value_pairs(spark, folder):
    """Each event's value and the next one of its user, in cents."""
    rows = events(spark, folder).select("user_id", "event_id", "ts", cents().cast("double").alias("predicted"))
    pairs = next_in_sequence(rows, ["user_id"], ["ts", "event_id"], "predicted", "actual")
    return pairs.select("event_id", "actual", "predicted", (F.col("predicted") * 2).alias("high"), (F.col("predicted") / 2).alias("low"))


def _pinball(q: str, c: str) -> str:
    return f"avg(greatest((actual - {c}) * {q}, (actual - {c}) * ({q} - 1)))"


@query(
    "regression_metrics",
    "WITH v AS (SELECT user_id, event_id, ts, CAST(round(value * 1e2) AS DOUBLE) AS mid FROM events), "
    "p AS (SELECT *, lead(mid) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS actual, mid * 2 AS high, mid / 2 AS low FROM v) SELECT "
    + ", ".join(
        f"{_pinball(q, c)} AS val_pinball_{n}, avg(abs(actual - {c})) AS val_mae_{n}, sqrt(avg((actual - {c}) * (actual - {c}))) AS val_rmse_{n}"
        for q, c, n in (("0.25e0", "low", "p25"), ("0.5e0", "mid", "p50"), ("0.75e0", "high", "p75"))
    )
    + ", avg(CASE WHEN actual BETWEEN low AND high THEN 1e0 ELSE 0e0 END) AS val_coverage FROM p WHERE actual IS NOT NULL",
)
def regression_metrics(spark, folder):
    return evaluate(value_pairs(spark, folder), "actual", {0.25: "low", 0.5: "predicted", 0.75: "high"})


@query(
    "ordered_split",
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= greatest(CAST(floor((SELECT count(*) FROM events) * 0.8e0) AS BIGINT), 1) AS is_train
       FROM events""",
)
def split_by_time(spark, folder):
    train, valid = ordered_split(events(spark, folder), ["ts", "event_id"])
    return train.select("event_id", F.lit(True).alias("is_train")).unionByName(valid.select("event_id", F.lit(False).alias("is_train")))


@query(
    "series_index",
    f"""WITH {MINUTES} SELECT event_type, minute_s, concat_ws('_', event_type, CAST(active_users AS VARCHAR)) AS series_id,
        dense_rank() OVER (ORDER BY minute) - 1 AS time_idx FROM scored""",
)
def series_index(spark, folder):
    indexed = add_time_index(add_series_id(minute_facts(spark, folder), "event_type", "active_users"), "minute")
    return indexed.select("event_type", seconds("minute").alias("minute_s"), "series_id", "time_idx")


@query(
    "encoder_window",
    """WITH w AS (
         SELECT event_id, CAST(round(value * 1e2) AS BIGINT) AS c,
                row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, event_type FROM events)
       SELECT a.event_id, count(b.c) AS steps, arg_min(b.c, b.n) AS first_cents, CAST(sum(b.c) AS BIGINT) AS sum_cents
       FROM w a JOIN w b ON a.event_type = b.event_type AND b.n BETWEEN a.n - 16 AND a.n - 1
       GROUP BY a.event_id HAVING count(b.c) >= 4""",
)
def encoder_window(spark, folder, **options):
    rows = events(spark, folder).select("event_type", "event_id", "ts", cents().alias("cents"))
    windows = encoder_windows(rows, ["event_type"], ["ts", "event_id"], ["cents"], **options)
    return windows.select(
        "event_id",
        F.size("encoder").cast("long").alias("steps"),
        F.get("encoder", F.lit(0))["cents"].alias("first_cents"),
        F.aggregate("encoder", F.lit(0).cast("long"), lambda total, x: total + x["cents"]).alias("sum_cents"),
    )


@query("encoder_window_sliced", ORACLES["encoder_window"])
def encoder_window_sliced(spark, folder):
    return encoder_window(spark, folder, rows_per_slice=1000)


@query("select_features", "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def select_features(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(*pick_features(lines, ["l_quantity", "no_such_column", "l_discount", "l_tax"], []))


@query(
    "training_rows",
    f"""WITH {GOLD} SELECT event_type, minute_s, active_users, rolling_mean_7d, hist_p50, hist_p90, label_p50 FROM gold
        WHERE horizon_min = 20 AND label_p50 IS NOT NULL
          AND minute >= TIMESTAMP '2024-01-05 00:00:00' AND minute <= TIMESTAMP '2024-01-25 00:00:00'""",
)
def labelled_rows(spark, folder):
    rows = training_rows(
        gold_rows(spark, folder),
        20,
        "2024-01-05 00:00:00",
        "2024-01-25 00:00:00",
        features=["active_users", "rolling_mean_7d", "hist_p50", "hist_p90"],
        extra=["event_type", "minute"],
    )
    return rows.withColumn("minute_s", seconds("minute")).drop("minute")


@query(
    "training_features",
    f"WITH {GOLD} SELECT event_type, minute_s, score, label_p50 FROM gold WHERE horizon_min = 10 AND minute >= TIMESTAMP '2024-01-10 00:00:00'",
)
def features_of_horizon(spark, folder):
    rows = training_features(gold_rows(spark, folder), 10, "2024-01-10 00:00:00")
    return rows.select("event_type", seconds("minute").alias("minute_s"), "score", "label_p50")


@query(
    "registry_latest",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS version, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
)
def registry_latest(spark, folder):
    newest = registry.latest_entries(table(spark, folder, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return newest.select("o_custkey", "o_orderkey", version_stamp(F.col("o_orderdate")).alias("version"), "o_totalprice")


@query("compaction", "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events")
def compaction(spark, folder):
    path = work_path(spark, "compaction")
    rows = events(spark, folder).withColumn("date", F.to_date("ts"))
    rows.repartition(8).write.partitionBy("date").parquet(path)
    compact(spark, path, ["user_id", "event_type"], partition_by=["date"])
    return read_table(spark, path).select("event_id", "user_id", "event_type", "value", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("clustering", "SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM events")
def clustering(spark, folder):
    path = work_path(spark, "clustering")
    events(spark, folder).write.parquet(f"{path}/given")
    cluster(spark, f"{path}/given", ["user_id", "event_type", "ts"], target=f"{path}/curve", files=16)
    rows = read_table(spark, f"{path}/curve")
    return rows.select("event_id", "user_id", "event_type", "value", seconds("ts").alias("ts_s"))


@query("checked_write", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, value IS NOT NULL AND value >= 10 AS good FROM events")
def checked_write(spark, folder):
    """One write whose checks are counted on the way; rows that fail go to a table of their own."""
    path = work_path(spark, "checked")
    rows = events(spark, folder).select("event_id", "value", F.to_date("ts").alias("date"))
    checks = [not_null("value"), between("value", low=10.0)]
    write_checked(rows, f"{path}/good", "date", checks, "events", f"{path}/bad")
    write_checked(rows.filter("value >= 10"), f"{path}/good", "date", checks, "events")
    both = read_table(spark, f"{path}/good").withColumn("good", F.lit(True))
    both = both.unionByName(read_table(spark, f"{path}/bad").withColumn("good", F.lit(False)))
    return both.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "good")


@query(
    "partition_overwrite",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN value + 1 ELSE value END AS value FROM events""",
)
def partition_overwrite(spark, folder):
    path = work_path(spark, "overwrite")
    rows = events(spark, folder).select("event_id", "value", F.to_date("ts").alias("date"))
    overwrite_partitions(rows, path, ["date"])
    one_day = rows.filter(F.col("date") == F.lit("2024-01-10").cast("date")).withColumn("value", F.col("value") + 1)
    overwrite_partitions(one_day, path, ["date"])
    return read_table(spark, path).select(F.date_format("date", "yyyy-MM-dd").alias("day"), "event_id", "value")


@query("dimension_csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def dimension_csv_roundtrip(spark, folder):
    path = work_path(spark, "schedule")
    table(spark, folder, "part").write.option("header", True).csv(f"{path}/part.txt")
    csv_to_parquet(spark, path, path, ["part", "no_such_table"])
    return read_dimension(spark, path, "part", {"p_partkey": "long", "p_size": "int", "p_retailprice": "double"})


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def line_rows(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", *LINE_FEATURES, "l_extendedprice"]
    return table(spark, folder, "lineitem").select(columns)


def line_split(spark, folder):
    return ordered_split(
        line_rows(spark, folder),
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
    )


@query("quantile_model")
def quantile_model(spark, folder):
    train, valid = line_split(spark, folder)
    params = BoostingParams(rounds=12, leaves=8, learning_rate=0.3, early_stopping=3, checkpoint_every=5)
    models = dict(zip(("p50", "p90"), fit_quantiles(train, valid, LINE_FEATURES, "l_extendedprice", (0.5, 0.9), params), strict=True))
    return score(line_rows(spark, folder), models).select("l_orderkey", "l_linenumber", "l_extendedprice", "p50", "p90")


LINES = """
numbered AS (
  SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n,
         greatest(CAST(floor((SELECT count(*) FROM lineitem) * 0.8e0) AS BIGINT), 1) AS cut FROM lineitem),
train AS (SELECT l_quantity AS x, l_extendedprice AS y FROM numbered WHERE n <= cut)
"""


@query(
    "quantile_baseline",
    f"""WITH {LINES}, base AS (SELECT quantile_disc(y, 0.5) AS p50, quantile_disc(y, 0.9) AS p90 FROM train)
        SELECT l_orderkey, l_linenumber, l_extendedprice, p50, p90 FROM lineitem, base""",
)
def quantile_baseline(spark, folder):
    """Models without trees: the exact quantiles of the training rows."""
    train, valid = line_split(spark, folder)
    params = BoostingParams(rounds=0)
    models = dict(zip(("p50", "p90"), fit_quantiles(train, valid, LINE_FEATURES, "l_extendedprice", (0.5, 0.9), params), strict=True))
    return score(line_rows(spark, folder), models).select("l_orderkey", "l_linenumber", "l_extendedprice", "p50", "p90")


BINS = 64


@query(
    "quantile_stump",
    f"""WITH {LINES}, base AS (SELECT quantile_disc(y, 0.9) AS b FROM train),
        moved AS (SELECT x, y - b AS e, CAST(CASE WHEN y - b > 0 THEN 9000 ELSE -1000 END AS BIGINT) AS g FROM train, base),
        bounds AS (SELECT DISTINCT unnest(quantile_disc(x, [{", ".join(str(i / BINS) for i in range(1, BINS + 1))}])) AS bound FROM train),
        inner_bounds AS (SELECT bound FROM bounds WHERE bound < (SELECT max(bound) FROM bounds)),
        whole AS (SELECT count(*) AS n, CAST(sum(g) AS DOUBLE) AS s FROM moved),
        sides AS (SELECT bound, count(*) AS nl, CAST(sum(g) AS DOUBLE) AS sl FROM inner_bounds JOIN moved ON x <= bound GROUP BY 1),
        gains AS (SELECT bound, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM sides, whole WHERE nl >= 20 AND n - nl >= 20),
        best AS (SELECT bound FROM gains ORDER BY gain DESC, bound LIMIT 1),
        leaves AS (SELECT bound, quantile_disc(e, 0.9) FILTER (WHERE x <= bound) AS low, quantile_disc(e, 0.9) FILTER (WHERE x > bound) AS high
                   FROM moved, best GROUP BY 1)
        SELECT l_orderkey, l_linenumber, l_extendedprice, b + CASE WHEN l_quantity <= bound THEN low ELSE high END AS p90
        FROM lineitem, base, leaves""",
)
def quantile_stump(spark, folder):
    """One split and its two leaves, which SQL can find as well."""
    train, _ = line_split(spark, folder)
    params = BoostingParams(rounds=1, leaves=2, learning_rate=1.0, bins=BINS)
    model = fit_quantile(train, None, ["l_quantity"], "l_extendedprice", 0.9, params)
    return model.predict(line_rows(spark, folder), "p90").select("l_orderkey", "l_linenumber", "l_extendedprice", "p90")


@query(
    "feature_matrix",
    """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS FLOAT) AS label, CAST(l_quantity AS FLOAT) AS f0,
              CAST(l_discount AS FLOAT) AS f1, CAST(l_tax AS FLOAT) AS f2 FROM lineitem""",
)
def feature_vectors(spark, folder):
    rows = feature_matrix(line_rows(spark, folder), LINE_FEATURES, label="l_extendedprice")
    parts = vector_to_array("features", "float32")
    return rows.select("l_orderkey", "l_linenumber", F.col("label").cast("float").alias("label"), *[parts[i].alias(f"f{i}") for i in range(3)])


@query("parameter_search")
def parameter_search(spark, folder):
    """Twenty candidates grown together and halved after 1, 2, 4, 8 and 16 rounds; errors of the last one's model."""
    train, valid = line_split(spark, folder)
    found = halving_search(train, valid, LINE_FEATURES, "l_extendedprice", 0.5, 20, BoostingParams(rounds=32, early_stopping=5))
    return evaluate(found.model.predict(valid, "p50"), "l_extendedprice", {0.5: "p50"})


@query("train_job")
def train_job(spark, folder):
    root = work_path(spark, "train")
    gold = gold_rows(spark, folder).select(
        F.col("event_type").alias("origin_stop"),
        F.lit("all").alias("dest_stop"),
        "minute",
        "horizon_min",
        F.col("active_users").alias("active_trips"),
        F.col("avg_value").alias("avg_departure_delay_s"),
        "rolling_mean_7d",
        "hist_p50",
        "hist_p90",
        "label_p50",
    )
    gold.write.parquet(f"{root}/gold")
    run_training(spark, root, TrainingConfig(trials=1, boosting=BoostingParams(rounds=6, leaves=8, early_stopping=2, checkpoint_every=3)))
    return registry.report(spark, f"{root}/reports").select("model_name", "kind", "name", "number")


@query(
    "registry_report",
    """WITH v AS (SELECT user_id, event_id, ts, CAST(round(value * 1e2) AS DOUBLE) AS mid FROM events),
       p AS (SELECT mid, lead(mid) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS actual FROM v),
       m AS (SELECT avg(abs(actual - mid)) AS mae FROM p WHERE actual IS NOT NULL),
       runs AS (SELECT unnest([1, 2]) AS hour)
       SELECT 'gbt' AS model_name, '202401010' || hour || '0000' AS version, 'metric' AS kind, 'val_mae_p50' AS name, mae AS number, NULL::VARCHAR AS text FROM runs, m
       UNION ALL SELECT 'gbt', '202401010' || hour || '0000', 'artifact', 'p50', NULL, 'models/' || hour FROM runs""",
)
def registry_report(spark, folder):
    """The reports of two runs, read back."""
    root = work_path(spark, "report")
    measured = evaluate(value_pairs(spark, folder), "actual", {0.5: "predicted"}).first().asDict()
    for hour in (1, 2):
        created = datetime(2024, 1, 1, hour, tzinfo=timezone.utc)
        entry = registry.register(spark, f"{root}/registry", "gbt", {"p50": f"models/{hour}"}, {}, measured, created_at=created)
        registry.append_report(spark, f"{root}/reports", entry)
    rows = registry.report(spark, f"{root}/reports").filter("kind = 'artifact' or name = 'val_mae_p50'")
    return rows.select("model_name", "version", "kind", "name", "number", "text")


@query(
    "registry_append",
    """WITH v AS (SELECT user_id, event_id, ts, CAST(round(value * 1e2) AS DOUBLE) AS mid FROM events),
       p AS (SELECT mid, lead(mid) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS actual FROM v)
       SELECT 'gbt' AS model_name, '20240101020000' AS version, '{"hour": 2}' AS params, '2024-01-01T02:00:00' AS created_at,
              avg(abs(actual - mid)) AS mae FROM p WHERE actual IS NOT NULL""",
)
def registry_append(spark, folder):
    root = work_path(spark, "registry")
    measured = evaluate(value_pairs(spark, folder), "actual", {0.5: "predicted"}).first().asDict()
    for hour in (1, 2):
        created = datetime(2024, 1, 1, hour, tzinfo=timezone.utc)
        entry = registry.register(spark, f"{root}/registry", "gbt", {"p50": f"{root}/p50"}, {"hour": hour}, measured, created_at=created)
        registry.append_report(spark, f"{root}/reports", entry)
    return registry.latest_entries(registry.entries(spark, f"{root}/registry"), ["model_name"], "created_at", ["version"]).select(
        "model_name", "version", "params", "created_at", F.col("metrics")["val_mae_p50"].alias("mae")
    )
