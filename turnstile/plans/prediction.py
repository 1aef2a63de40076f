"""Batch predictions and the map table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions.times import minute_of_day
from turnstile.functions.values import valid_horizon
from turnstile.operators.boosting import QuantileModel, score
from turnstile.operators.curate import split_rows
from turnstile.operators.features import lookup_with_rollup
from turnstile.operators.joins import add_names, resolve_ids
from turnstile.operators.serving import fallback_scores, shape_predictions


def check_requests(requests: DataFrame, low: int = 5, high: int = 120) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and those with a horizon out of range or a missing stop."""
    stops = F.col("origin_stop").isNotNull() & F.col("dest_stop").isNotNull()
    return split_rows(requests, stops & valid_horizon(F.col("horizon_min"), low, high))


def predict_batch(
    requests: DataFrame,
    snapshot: DataFrame,
    stations: DataFrame,
    children: DataFrame,
    *,
    models: dict[str, QuantileModel] | None = None,
    now: Column | None = None,
    max_combinations: int | None = None,
) -> DataFrame:
    """p50 and p90 per request; stops may be given by id or by name.

    ``requests`` holds valid rows (see ``check_requests``); further columns are
    kept. Without models the rolling mean stands in.
    """
    named = resolve_ids(resolve_ids(requests, "origin_stop", stations), "dest_stop", stations)
    featured = lookup_with_rollup(named.select(*requests.columns), snapshot, children, max_combinations=max_combinations)
    featured = featured.withColumn("minute_of_day", minute_of_day(F.current_timestamp() if now is None else now))
    scored = score(featured, models) if models else fallback_scores(featured)
    scored = add_names(add_names(scored, "origin_stop", "origin_name", stations), "dest_stop", "dest_name", stations)
    return shape_predictions(scored, [*requests.columns, "origin_name", "dest_name", "source"])
