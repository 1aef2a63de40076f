"""Job entry (B4): ``spark-submit jobs.py --mode silver --data-root /data``."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from turnstile.operators.boosting import BoostingParams
from turnstile.operators.features import FEATURES, KEY, children_of, latest_per_key
from turnstile.operators.joins import named_stations
from turnstile.operators.serving import map_points
from turnstile.plans import transit
from turnstile.plans.batch import run_gold, run_silver, validate_tables
from turnstile.plans.incremental import read_gold_by_day, run_gold_by_day, run_silver_by_day, state_path
from turnstile.plans.landing import land_feed
from turnstile.plans.prediction import check_requests, predict_batch
from turnstile.plans.training import TrainingConfig, load_models, run_training
from turnstile.session import build_session
from turnstile.sources.change_feed import change_stream, read_live
from turnstile.sources.feature_log import compact_log, read_snapshot
from turnstile.sources.tables import cluster, compact, csv_to_parquet, read_dimension
from turnstile.sources.topics import file_stream, kafka_stream
from turnstile.streaming.bronze import merge_batches, start_bronze
from turnstile.streaming.keyed_state import read_state, start_keyed_state
from turnstile.streaming.materialize import published_columns, start_materializer, table_stream

MODES = ("land", "bronze", "silver", "gold", "validate", "schedule", "compact", "compact-features", "materialize", "train", "predict", "map")


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(description="Transit crowding jobs")
    args.add_argument("--mode", choices=MODES, required=True)
    args.add_argument("--topic", default=transit.VEHICLES)
    args.add_argument("--data-root", default="data")
    args.add_argument("--gtfs-root", default=None)
    args.add_argument("--schema-root", default=None, help="folder of {topic}.value.schema.json; its contracts come before the built-in ones")
    args.add_argument("--h3-res", type=int, default=8)
    args.add_argument("--horizons", nargs="*", type=int, default=list(transit.HORIZONS))
    args.add_argument("--date", default=None, help="one date, YYYY-MM-DD")
    args.add_argument("--source", default=None, help="folder of landed messages, schedule files or requests")
    args.add_argument("--target", default=None, help="output folder of predict, map and compact-features")
    args.add_argument("--table", default="silver", choices=["silver", "gold", "bronze"], help="table to compact; of bronze the batches of --date in --topic")
    args.add_argument("--order-by", nargs="*", default=list(transit.SERIES))
    args.add_argument("--curve", action="store_true", help="compact along a curve over all columns of --order-by")
    args.add_argument("--available-now", action="store_true", help="stop a stream when its input is read")
    args.add_argument("--horizon", type=int, default=10)
    args.add_argument("--rounds", type=int, default=BoostingParams.rounds)
    args.add_argument("--early-stopping", type=int, default=BoostingParams.early_stopping)
    args.add_argument("--trials", type=int, default=0)
    args.add_argument("--start", default=None, help="first minute of the training rows")
    args.add_argument("--end", default=None, help="last minute of the training rows")
    args.add_argument("--quantiles", nargs="*", type=float, default=list(transit.QUANTILES))
    args.add_argument("--features", nargs="*", default=list(FEATURES))
    args.add_argument("--on-fail", default="raise", choices=["raise", "quarantine"])
    args.add_argument("--dedupe", default=None, choices=["latest"])
    args.add_argument("--label-mode", default="rows", choices=["rows", "minutes"])
    args.add_argument("--as-of", default=None, help="end of the rows that the historic quantiles cover")
    args.add_argument("--exact-quantiles", action="store_true")
    args.add_argument("--by-day", action="store_true", help="only changed dates: silver, gold; and what follows from them: materialize, train, predict, map")
    args.add_argument("--max-offsets", type=int, default=None, help="bound on a micro-batch from Kafka")
    args.add_argument("--feature-ttl", type=int, default=0, help="seconds; 0 keeps all features")
    args.add_argument("--keyed-state", action="store_true", help="keep the snapshot in the state of the stream: materialize, predict, map")
    return args


def snapshot(spark: SparkSession, root: str, args: argparse.Namespace) -> DataFrame:
    """The feature snapshot: of the stream's state with ``--keyed-state``, else of the log of
    batches, or of the log of changes with ``--by-day``."""
    keys = [*transit.SERIES, "horizon_min"] if args.by_day else list(KEY)
    if args.keyed_state:
        rows = read_state(spark, f"{root}/checkpoints/feature_state", keys, ttl_seconds=args.feature_ttl)
        rows = rows.filter("op <> 'delete'").drop("op", "version") if args.by_day else rows
    elif args.by_day:
        rows = read_live(spark, transit.features_path(root), keys, args.feature_ttl)
    else:
        rows = read_snapshot(spark, transit.features_path(root), ttl_seconds=args.feature_ttl)
    if not args.by_day:
        return rows
    return latest_per_key(rows, KEY, ("minute", "h3"), [c for c in rows.columns if c not in KEY])


def follow(spark: SparkSession, root: str, args: argparse.Namespace):
    """The stream that brings the feature log up to date."""
    log = logging.getLogger("turnstile.materialize")
    options = {"on_counts": lambda batch, counts: log.info("batch %s: %s", batch, counts), "available_now": args.available_now}
    checkpoint = f"{root}/checkpoints/online_features"
    if args.by_day:
        changes = change_stream(spark, state_path(transit.gold_days_path(root), "changes"))
        rows = changes.select(*KEY, "h3", "minute", *FEATURES, "op", "version")
        by = {"keys": [*transit.SERIES, "horizon_min"], "order": ("version",)}
    else:
        rows, by = published_columns(table_stream(spark, transit.gold_path(root))), {}
    if args.keyed_state:
        state, expired = f"{root}/checkpoints/feature_state", transit.expired_path(root)
        return start_keyed_state(rows, state, expired, ttl_seconds=args.feature_ttl, available_now=args.available_now, **by)
    return start_materializer(rows, transit.features_path(root), checkpoint, **by, **options)


def run(spark: SparkSession, args: argparse.Namespace):
    root = args.data_root
    schedule = args.gtfs_root or transit.schedule_root(root)
    silver = {"schedule": schedule, "resolution": args.h3_res, "on_fail": args.on_fail, "dedupe": args.dedupe, "schema_root": args.schema_root}
    if args.mode == "land":
        return land_feed(spark, args.source, args.topic, root)
    if args.mode == "bronze":
        messages = file_stream(spark, args.source) if args.source else kafka_stream(spark, args.topic, max_offsets=args.max_offsets)
        query = start_bronze(messages, transit.contract(spark, args.topic, args.schema_root), args.topic, root, available_now=args.available_now)
        return query.awaitTermination()
    if args.mode == "silver" and args.by_day:
        return run_silver_by_day(spark, root, **silver)
    if args.mode == "silver":
        return run_silver(spark, root, date=args.date, **silver)
    if args.mode == "gold" and args.by_day:
        return run_gold_by_day(spark, transit.silver_path(root), transit.gold_days_path(root), horizons=args.horizons)
    if args.mode == "gold":
        return run_gold(
            spark, root, args.horizons, label_mode=args.label_mode, as_of=args.as_of, exact_quantiles=args.exact_quantiles
        )
    if args.mode == "validate":
        return validate_tables(spark, {"silver": transit.silver_path(root), "gold": transit.gold_path(root)})
    if args.mode == "schedule":
        return csv_to_parquet(spark, args.source, schedule)
    if args.mode == "compact" and args.table == "bronze":
        if not args.date:
            raise ValueError("bronze is compacted date by date: give --date")
        return merge_batches(spark, transit.bronze_path(root, args.topic), args.date)
    if args.mode == "compact":
        gold = args.table == "gold"
        path, by = (transit.gold_path(root), ["date", "horizon_min"]) if gold else (transit.silver_path(root), ["date"])
        return (cluster if args.curve else compact)(spark, path, args.order_by, partition_by=by, date=args.date)
    if args.mode == "compact-features":
        return compact_log(spark, transit.features_path(root), args.target)
    if args.mode == "map":
        return map_points(snapshot(spark, root, args), list(KEY)).write.mode("overwrite").parquet(args.target)
    if args.mode == "materialize":
        return follow(spark, root, args).awaitTermination()
    if args.mode == "train":
        config = TrainingConfig(
            horizon_min=args.horizon,
            start=args.start,
            end=args.end,
            features=args.features,
            quantiles=args.quantiles,
            trials=args.trials,
            boosting=BoostingParams(rounds=args.rounds, early_stopping=args.early_stopping),
        )
        return run_training(spark, root, config, read_gold_by_day(spark, transit.gold_days_path(root)) if args.by_day else None)
    stops = read_dimension(spark, schedule, "stops")
    requests, _ = check_requests(spark.read.parquet(args.source))
    if requests.isEmpty():
        raise ValueError("no valid requests")
    predicted = predict_batch(
        requests,
        snapshot(spark, root, args),
        named_stations(stops),
        children_of(stops),
        models=load_models(spark, root),
    )
    return predicted.write.mode("overwrite").parquet(args.target)


def main(argv: Sequence[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    args = parser().parse_args(argv)
    spark = build_session(f"turnstile-{args.mode}")
    try:
        run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
