"""Gold by the day: what one day hands on to others is kept, so a day is computed alone.

A day's rows depend on other days in three ways, and a small state per series and
day stands for each:

- the rolling window at the start of a day is the sum of the *totals* (count, sum,
  sum of squares in fixed point) of the days that it covers whole; within the day
  only the rows of the day that drops out of it are needed besides the day's own;
- labels of a day's last rows reach into the *heads*, the first rows of the days
  after it;
- the historic quantiles of a series come from the merged *sketches* of its days.

Days are UTC days, numbered from 1970-01-01. Rows without a time are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.times import epoch_seconds
from turnstile.operators.gold import WEEK, fan_out, fixed_point, window_statistics
from turnstile.operators.slices import ROWS_PER_SLICE, sliced_window

DAY = 24 * 60 * 60
#: Size of a sketch: a rank is off by at most about 2.4 / SKETCH ** 0.94; exact up to this many rows.
SKETCH = 1024


def day_number(ts: str) -> Column:
    return F.floor(epoch_seconds(F.col(ts)) / DAY)


def _square(value: str) -> Column:
    return F.col(value).cast("decimal(19,0)") * F.col(value).cast("decimal(19,0)")


def day_totals(df: DataFrame, keys: Sequence[str], ts: str, value: str, digits: int = 6, sketch: int = SKETCH) -> DataFrame:
    """(keys, day, rows, n, total, squares, sketch): one row per key and day, pre-aggregated map-side.

    ``n`` counts the values that the rolling statistics count; the sketch holds the
    values that are not null and not NaN.
    """
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return (
        df.filter(F.col(ts).isNotNull())
        .select(*keys, day_number(ts).alias("day"), fixed_point(F.col(value), digits).alias("__v"), known.alias("__known"))
        .groupBy(*keys, "day")
        .agg(
            F.count("*").alias("rows"),
            F.count("__v").alias("n"),
            F.coalesce(F.sum("__v"), F.lit(0).cast("long")).alias("total"),
            F.coalesce(F.sum(_square("__v")), F.lit(0)).cast("decimal(38,0)").alias("squares"),
            F.kll_sketch_agg_double("__known", F.lit(int(sketch))).alias("sketch"),
        )
    )


def day_heads(df: DataFrame, keys: Sequence[str], ts: str, value: str, reach: int) -> DataFrame:
    """(keys, day, place, ts, value): the first ``reach`` rows of each key and day, from place 0."""
    rows = df.filter(F.col(ts).isNotNull()).select(*keys, day_number(ts).alias("day"), ts, value)
    place = F.row_number().over(Window.partitionBy(*keys, "day").orderBy(ts))
    return rows.withColumn("place", place.cast("long") - 1).filter(F.col("place") < reach)


def merged_quantiles(totals: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles per key from the sketches of its days; null for a key without values.

    As long as a key has no more values than the sketch holds, these are the exact
    discrete quantiles; beyond it their rank error is that of one sketch over all.
    """
    merged = totals.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    filled = F.kll_sketch_get_n_double("sketch") > 0
    return merged.select(
        *keys,
        *[F.when(filled, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(name) for name, p in probs.items()],
    )


def _places(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, day, start, end): where each day's rows stand among all rows of the key."""
    upto = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("rows").over(upto)
    return totals.select(*keys, "day", (end - F.col("rows")).alias("start"), end.alias("end"))


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on the keys and on ``__span``, null keys included; the right side keeps its other columns only."""
    marked = right.withColumnsRenamed({c: f"__right_{c}" for c in [*keys, "__span"]})
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in [*keys, "__span"]])
    return left.join(marked, on=equal).drop(*[f"__right_{c}" for c in [*keys, "__span"]])


def _spans(place: Column, reach: int, both: bool) -> Column:
    """Spans of ``reach`` places: the one of a place, or that and the next."""
    span = F.floor(place / reach)
    return F.explode(F.array(span, span + 1)) if both else span


def reached_days(totals: DataFrame, keys: Sequence[str], changed: Sequence[int], reach: int) -> DataFrame:
    """(day,): days whose last rows look at rows of a changed day, at most ``reach`` rows ahead in their key."""
    places = _places(totals, keys)
    froms = places.select(*keys, "day", "end", _spans(F.col("end"), reach, True).alias("__span"))
    ends = places.filter(F.col("day").isin(list(changed))).select(
        *keys, F.col("day").alias("__changed"), "start", _spans(F.col("start"), reach, False).alias("__span")
    )
    near = (F.col("start") >= F.col("end")) & (F.col("start") - F.col("end") < reach) & (F.col("day") < F.col("__changed"))
    return _meet(froms, ends, keys).filter(near).select("day").distinct()


def looking_back(changed: Sequence[int], window_seconds: int = WEEK) -> set[int]:
    """The changed days and those whose rolling window holds rows of one."""
    return {c + k for c in changed for k in range(window_seconds // DAY + 1)}


def dated_facts(
    rows: DataFrame,
    totals: DataFrame,
    heads: DataFrame,
    days: Sequence[int],
    keys: Sequence[str],
    ts: str,
    value: str,
    horizons: Sequence[int],
    *,
    window_seconds: int = WEEK,
    digits: int = 6,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """The rows of ``days`` with labels and rolling statistics, one per horizon, equal to those of ``gold_facts``.

    ``rows`` must hold these days and those that leave the window during them (a
    whole window earlier); others are not read. ``totals`` and ``heads`` cover all
    days. Labels go by rows. All that a day needs meets in one window by (keys, day).
    """
    if window_seconds % DAY:
        raise ValueError("the window must be whole days")
    keys, days, horizons = list(keys), sorted(days), [int(h) for h in horizons]
    width, reach = window_seconds // DAY, max(horizons)
    wanted = lambda c: F.col(c).isin(days)
    moved = {"__count": "long", "__total": "long", "__square": "decimal(38,0)"}

    timed = rows.filter(F.col(ts).isNotNull()).withColumn("__day", day_number(ts)).withColumn("__t", epoch_seconds(F.col(ts)))
    timed = timed.withColumn("__v", fixed_point(F.col(value), digits))
    timed = timed.withColumns(
        {
            "__count": F.col("__v").isNotNull().cast("long"),
            "__total": F.coalesce("__v", F.lit(0).cast("long")),
            "__square": F.coalesce(_square("__v"), F.lit(0)).cast("decimal(38,0)"),
        }
    )
    own = timed.filter(wanted("__day")).withColumn("__kind", F.lit("own")).drop("__v")
    leaving = timed.withColumns({"__day": F.col("__day") + width, "__t": F.col("__t") + window_seconds + 1})
    leaving = leaving.filter(wanted("__day") & F.col("__v").isNotNull())
    leaving = leaving.select(*keys, "__day", "__t", *[(-F.col(m)).cast(kind).alias(m) for m, kind in moved.items()])
    covered = totals.withColumn("__day", F.explode(F.sequence(F.col("day") + 1, F.col("day") + width))).filter(wanted("__day"))
    covered = covered.select(
        *keys, "__day", (F.col("__day") * DAY - 1).alias("__t"), F.col("n").alias("__count"), F.col("total").alias("__total"), F.col("squares").alias("__square")
    )
    places = _places(totals, keys)
    ends = places.filter(wanted("day")).select(*keys, F.col("day").alias("__day"), "end", _spans(F.col("end"), reach, True).alias("__span"))
    after = _on_day(heads, places, keys)
    after = after.withColumn("__at", F.col("start") + F.col("place")).withColumn("__span", _spans(F.col("__at"), reach, False))
    ahead = _meet(after.select(*keys, ts, value, "__at", "__span"), ends, keys).filter(
        (F.col("__at") >= F.col("end")) & (F.col("__at") - F.col("end") < reach)
    )
    ahead = ahead.select(*keys, "__day", epoch_seconds(F.col(ts)).alias("__t"), value).withColumn("__kind", F.lit("ahead"))
    moves = own.unionByName(leaving, True).unionByName(covered, True).unionByName(ahead, True)
    labels = {h: f"__label_{h}" for h in horizons}
    rolled = sliced_window(
        moves,
        [*keys, "__day"],
        ["__t"],
        totals={
            name: F.coalesce(F.col(m), F.lit(0)).cast(kind)
            for name, (m, kind) in zip(("__n", "__sum", "__squares"), moved.items(), strict=True)
        },
        keep=F.col("__kind").isNotNull(),
        near=lambda w: {name: F.lead(value, h).over(w) for h, name in labels.items()},
        after=reach,
        rows_per_slice=rows_per_slice,
    ).filter("__kind = 'own'")
    rolled = window_statistics(rolled, "rolling_mean_7d", "rolling_std_7d", digits)
    return fan_out(rolled.drop("__kind", "__t", "__day", "__n", "__sum", "__squares", *moved), labels)


def _on_day(heads: DataFrame, places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Heads with the start of their day, null keys included."""
    spans = places.select(*keys, F.col("day").alias("__span"), "start")
    return _meet(heads.withColumn("__span", F.col("day")), spans, keys).drop("__span")
