"""Tables a service or map reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.cells import cell_centre
from turnstile.functions.display import crowding_colour, crowding_level, marker_radius
from turnstile.functions.values import UNKNOWN

# Fixed value: the peak forecast without a model, as a multiple of the mean.
PEAK_FACTOR = 1.2


def fallback_scores(df: DataFrame, mean: str = "rolling_mean_7d") -> DataFrame:
    """p50 and p90 from the rolling mean alone; a missing mean counts as 0."""
    base = F.coalesce(F.col(mean).cast("double"), F.lit(0.0))
    return df.withColumns({"p50": base, "p90": base * PEAK_FACTOR})


def shape_predictions(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Response columns: p50 falls back to ``mean`` and 0, p90 to p50 and 0;
    p10 and p95 stay null where the model has none."""

    def optional(name: str) -> Column:
        return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")

    return df.select(
        *keep,
        F.coalesce(optional("p50"), optional("mean"), F.lit(0.0)).alias("p50"),
        F.coalesce(optional("p90"), optional("p50"), F.lit(0.0)).alias("p90"),
        optional("p10").alias("p10"),
        optional("p95").alias("p95"),
    )


def map_points(snapshot: DataFrame, keep: Sequence[str] = ("origin_stop", "dest_stop", "horizon_min"), centres: bool = True) -> DataFrame:
    """Snapshot rows as map points with level, colour, radius and place."""
    mean = F.coalesce(F.col("rolling_mean_7d"), F.lit(0.0))
    points = snapshot.select(
        *keep,
        F.coalesce("h3", F.lit(UNKNOWN)).alias("h3"),
        mean.alias("rolling_mean"),
        F.coalesce("hist_p50", mean).alias("p50"),
        F.coalesce("hist_p90", mean * PEAK_FACTOR).alias("p90"),
    )
    points = points.withColumns(
        {
            "level": crowding_level(F.col("p90")),
            "colour": crowding_colour(F.col("p90")),
            "radius": marker_radius(F.col("p90")),
        }
    )
    if centres:
        lat, lon = cell_centre(F.col("h3"))
        points = points.withColumns({"lat": lat, "lon": lon})
    return points


def sorted_by_name(df: DataFrame, label: str, *tiebreak: str) -> DataFrame:
    return df.orderBy(label, *tiebreak)


def recent_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    """Last ``n`` rows of each key, oldest first.

    The rank filter lets every task drop all but its own last n rows of a key
    before the shuffle, so a hot key costs n rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)
    return ranked.sort(*keys, *order)
