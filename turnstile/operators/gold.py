"""Labels, rolling statistics and quantiles per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions.times import epoch_seconds
from turnstile.operators.slices import ROWS_PER_SLICE, sliced_window

WEEK = 7 * 24 * 60 * 60


def fixed_point(value: Column, digits: int) -> Column:
    """The value to ``digits`` decimals as an integer; null for NaN and values that do not fit."""
    scaled = F.round(value.cast("double") * F.lit(10.0**digits))
    return F.when(F.abs(scaled) < F.lit(2.0**62), scaled.cast("long"))


def rolling_stats(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    *,
    window_seconds: int = WEEK,
    mean: str = "rolling_mean_7d",
    std: str = "rolling_std_7d",
    digits: int = 6,
    labels: dict[str, int] | None = None,
    per_key: DataFrame | None = None,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Mean and population deviation over [t - window, t], both ends included.

    A sliding frame would read its whole buffer again for every row. Instead
    each value enters at t and leaves one second after the window, and the
    running totals of these entries and exits are the window's count, sum and
    sum of squares. The sums are exact: values are taken to ``digits`` decimals
    as integers, so nothing drifts. Null values do not count, nor do NaN and
    values beyond 2**62 in these units.

    ``labels`` (``{name: n}``) adds the value n rows later on the same pass; it
    needs one row per key and second, as Silver has. ``per_key`` holds one row
    per key, whose columns are added on the same pass too.
    """
    other = [c for c in df.columns if c not in keys]
    moves = (
        df.withColumn("__t", epoch_seconds(F.col(ts)))
        .withColumn("__v", fixed_point(F.col(value), digits))
        .withColumn("__sign", F.explode(F.array(F.lit(1), F.lit(-1))))
        .filter("__sign = 1 or __v is not null")
    )
    entering = F.col("__sign") == 1
    # Exits carry nothing but key, time and value.
    moves = moves.withColumns({c: F.when(entering, F.col(c)) for c in other}).withColumn(
        "__t", F.when(entering, F.col("__t")).otherwise(F.col("__t") + window_seconds + 1)
    )
    square = F.col("__v").cast("decimal(19,0)") * F.col("__v").cast("decimal(19,0)")
    measures = {
        "__n": F.when(F.col("__v").isNull(), 0).otherwise(F.col("__sign")).cast("long"),
        "__sum": F.coalesce(F.col("__v") * F.col("__sign"), F.lit(0).cast("long")),
        "__squares": F.coalesce(square * F.col("__sign"), F.lit(0)).cast("decimal(38,0)"),
    }

    def later(window):
        return {name: F.lead(value, rows).over(window) for name, rows in labels.items()}

    rolled = sliced_window(
        moves,
        keys,
        ["__t"],
        totals=measures,
        keep=entering,
        near=later if labels else None,
        after=max(labels.values()) if labels else 0,
        per_key=per_key,
        rows_per_slice=rows_per_slice,
    )
    return window_statistics(rolled, mean, std, digits).drop("__t", "__v", "__sign", *measures)


def window_statistics(rolled: DataFrame, mean: str, std: str, digits: int) -> DataFrame:
    """Mean and deviation from the running count, sum and sum of squares ``__n``, ``__sum``, ``__squares``."""
    n, total = F.col("__n"), F.col("__sum")
    spread = n * F.col("__squares") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    scale = F.lit(10.0**digits)
    return rolled.withColumn(mean, F.when(n > 0, total.cast("double") / n / scale)).withColumn(
        std, F.when(n > 0, F.sqrt(spread.cast("double")) / n / scale)
    )


def row_labels(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    horizons: Sequence[int],
    prefix: str = "label_",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``{prefix}{h}``: the value h rows later in the key."""
    return sliced_window(
        df,
        keys,
        order,
        near=lambda w: {f"{prefix}{h}": F.lead(value, h).over(w) for h in horizons},
        after=max(horizons),
        rows_per_slice=rows_per_slice,
    )


def fan_out(df: DataFrame, labels: dict[int, str], horizon: str = "horizon_min", label: str = "label_p50") -> DataFrame:
    """One row per horizon from one wide row; equals the union of one frame per
    horizon, without planning the input once for each."""
    pairs = [F.struct(F.lit(h).alias(horizon), F.col(c).alias(label)) for h, c in labels.items()]
    kept = [c for c in df.columns if c not in labels.values()]
    return df.withColumn("__pair", F.explode(F.array(*pairs))).select(*kept, f"__pair.{horizon}", f"__pair.{label}")


def minute_labels(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    horizons: Sequence[int],
    horizon: str = "horizon_min",
    label: str = "label_p50",
) -> DataFrame:
    """One row per horizon, labelled with the value exactly h minutes later.

    Null where that minute is missing. Needs one row per key and minute.
    """
    later = df.select(*keys, epoch_seconds(F.col(ts)).alias("__due"), F.col(value).alias(label))
    due = epoch_seconds(F.col(ts)) + F.col(horizon) * 60
    spread = df.withColumn(horizon, F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    return spread.withColumn("__due", due).join(later, on=[*keys, "__due"], how="left").drop("__due")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles per key in one sketch, merged map-side first.

    The rank error is at most n / ``accuracy``.
    """
    wanted = F.percentile_approx(value, [float(p) for p in probs.values()], accuracy)
    return (
        df.groupBy(*keys)
        .agg(wanted.alias("__q"))
        .select(*keys, *[F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    )


def exact_group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Exact discrete quantiles: the least value with at least p of the rows.

    Rows are first counted per (key, value), map-side; running counts along the
    values then place each quantile, hot keys slice by slice.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    upto = sliced_window(
        counts, keys, [value], totals={"__upto": F.col("__n")}, per_key=total, rows_per_slice=rows_per_slice
    )
    return upto.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("__upto") >= F.ceil(F.col("__total") * F.lit(float(p))), F.col(value))).alias(name)
            for name, p in probs.items()
        ]
    )


def gold_facts(
    silver: DataFrame,
    keys: Sequence[str] = ("origin_stop", "dest_stop", "h3"),
    minute: str = "minute",
    score: str = "crowding_score",
    horizons: Sequence[int] = (10, 20, 30),
    *,
    label_mode: str = "rows",
    probs: dict[str, float] | None = None,
    accuracy: int = 10_000,
    exact_quantiles: bool = False,
    as_of: str | None = None,
    digits: int = 6,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """The fact table: Silver's columns, one row per horizon.

    ``label_mode="rows"`` labels with the row ``h`` rows later, as the original
    job does even over gaps; ``"minutes"`` with the row h minutes later.
    The quantiles cover the whole series, also after the row, unless ``as_of``
    (a timestamp) ends their input. Rolling statistics and labels are computed
    once and fanned out over the horizons at the end.
    """
    keys, horizons = list(keys), [int(h) for h in horizons]
    probs = probs or {"hist_p50": 0.5, "hist_p90": 0.9}
    past = silver if as_of is None else silver.filter(F.col(minute) <= F.lit(as_of).cast("timestamp"))
    if exact_quantiles:
        quantiles = exact_group_quantiles(past, keys, score, probs, rows_per_slice)
    else:
        quantiles = group_quantiles(past, keys, score, probs, accuracy)
    wide = {h: f"__label_{h}" for h in horizons}
    labels = {name: h for h, name in wide.items()} if label_mode == "rows" else None
    # A null in a key never meets its quantiles, as in an equi-join.
    rolled = rolling_stats(
        silver, keys, minute, score, digits=digits, labels=labels, per_key=quantiles.dropna(subset=keys), rows_per_slice=rows_per_slice
    )
    if label_mode == "rows":
        facts = fan_out(rolled, wide)
    elif label_mode == "minutes":
        facts = minute_labels(rolled, keys, minute, score, horizons)
    else:
        raise ValueError(f"unknown label mode: {label_mode}")
    return facts.withColumn("date", F.to_date(minute))
