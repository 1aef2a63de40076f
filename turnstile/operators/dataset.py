"""Training sets and series windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.values import number_or_zero, series_id
from turnstile.operators.curate import in_time_range, on_horizon, require_columns
from turnstile.operators.features import FEATURES
from turnstile.operators.slices import ROWS_PER_SLICE, positions, sliced_window

# Series features in order of preference, and what is never one.
SERIES_FEATURES = (
    *FEATURES,
    "avg_arrival_delay_s",
    "avg_temp_c",
    "avg_wind_speed",
    "avg_precip_mm",
    "rolling_std_7d",
    "crowding_score",
)
NOT_FEATURES = ("label_p50", "minute", "origin_stop", "dest_stop", "h3", "time_idx", "series_id")
ENCODER_ROWS = 16


def training_rows(
    gold: DataFrame,
    horizon: int,
    start: str | None = None,
    end: str | None = None,
    *,
    features: Sequence[str] = FEATURES,
    label: str = "label_p50",
    extra: Sequence[str] = ("origin_stop", "dest_stop", "minute"),
    ts: str = "minute",
) -> DataFrame:
    """Labelled rows of one horizon in a time range, whatever the source is."""
    require_columns(gold, [*features, label, *extra])
    date_column = "date" if "date" in gold.columns else None
    rows = in_time_range(on_horizon(gold, horizon), ts, start, end, date_column)
    return rows.dropna(subset=[label]).select(*features, label, *extra)


def training_features(gold: DataFrame, horizon: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """All columns of one horizon in a time range."""
    return in_time_range(on_horizon(gold, horizon), "minute", start, end, "date" if "date" in gold.columns else None)


def as_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as float32 numbers: unreadable or null values become 0."""
    return df.withColumns({c: number_or_zero(F.col(c)).cast("float") for c in features})


def feature_matrix(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "label_p50") -> DataFrame:
    """Add ``features`` (a vector) and ``label`` (float32; null becomes 0)."""
    require_columns(df, [*features, label])
    numeric = as_features(df, features).withColumn("label", F.coalesce(F.col(label).cast("float"), F.lit(0.0).cast("float")))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(numeric)


def add_series_id(df: DataFrame, *parts: str, name: str = "series_id") -> DataFrame:
    return df.withColumn(name, series_id(*[F.col(p) for p in parts]))


def add_time_index(df: DataFrame, ts: str, name: str = "time_idx", rows_per_slice: int | None = ROWS_PER_SLICE) -> DataFrame:
    """0-based number of the row's time among all distinct times.

    Only the distinct times are numbered, then joined back.
    """
    times = df.select(ts).filter(F.col(ts).isNotNull()).distinct()
    placed = positions(times, [], [ts], "__position", rows_per_slice)
    return df.join(placed.select(ts, (F.col("__position") - 1).alias(name)), on=ts, how="left")


def min_encoder_rows(df: DataFrame, index: str = "time_idx", most: int = ENCODER_ROWS) -> int:
    """Least history a series needs: min(most, max(4, last index + 1))."""
    last = df.agg(F.max(index)).first()[0]
    return min(most, max(4, (-1 if last is None else int(last)) + 1))


def encoder_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    *,
    most: int = ENCODER_ROWS,
    least: int = 4,
    name: str = "encoder",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Add up to ``most`` feature rows before each row, oldest first.

    The row itself is the one-step target. Gaps in time are allowed; rows with
    fewer than ``least`` past rows are left out.
    """
    windows = sliced_window(
        df,
        keys,
        order,
        near=lambda w: {name: F.collect_list(F.struct(*features)).over(w.rowsBetween(-most, -1))},
        before=most,
        rows_per_slice=rows_per_slice,
    )
    return windows.filter(F.size(name) >= least)


def _raw(df: DataFrame, column: str) -> Column:
    """A column as the driver should see it: timestamps as microseconds, which
    no local time zone can bend."""
    stamp = isinstance(df.schema[column].dataType, T.TimestampType)
    return (F.unix_micros(column) if stamp else F.col(column)).alias(column)


def _literal(df: DataFrame, column: str, value) -> Column:
    kind = df.schema[column].dataType
    literal = F.timestamp_micros(F.lit(value).cast("long")) if isinstance(kind, T.TimestampType) else F.lit(value).cast(kind)
    return literal.alias(column)


def ordered_cutoff(df: DataFrame, order: Sequence[str], fraction: float = 0.8, accuracy: int = 10_000):
    """``order`` values of the last training row (timestamps in microseconds),
    or None for an empty table.

    A sketch of the first order column brackets the cutoff; the rows before the
    bracket are counted and only those inside it are numbered. One row comes to
    the driver.
    """
    rows = df.select(*[_raw(df, c) for c in order])
    along = F.col(order[0])
    slack = 2.0 / accuracy
    around = [max(fraction - slack, 0.0), min(fraction + slack, 1.0)]
    ends = rows.agg(F.percentile_approx(along, around, accuracy).alias("q"), F.count("*").alias("n"))
    first = ends.select(F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "n").first()
    if not first["n"]:
        return None
    target = max(int(first["n"] * fraction), 1)

    def numbered(part: DataFrame, position: int):
        return positions(part, [], order, "__position").filter(F.col("__position") == position).select(*order).first()

    kind = rows.schema[order[0]].dataType
    low, high = (F.lit(first[c]).cast(kind) for c in ("low", "high"))
    inside = rows.filter(along.between(low, high))
    # Outside the bracket only if the sketch was worse than promised.
    return numbered(inside, target - rows.filter(along < low).count()) or numbered(rows, target)


def ordered_split(df: DataFrame, order: Sequence[str], fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First ``max(int(fraction * n), 1)`` rows by ``order``, and the rest.

    ``order`` should be total and hold no nulls. The split itself is a filter,
    not a sort.
    """
    last = ordered_cutoff(df, order, fraction)
    if last is None:
        return df, df
    first = F.struct(*order) <= F.struct(*[_literal(df, c, last[c]) for c in order])
    return df.filter(first), df.filter(~first)
