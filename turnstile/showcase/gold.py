"""Gold: labels, rolling statistics, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators.carried import SKETCH, day_totals, merged_quantiles
from turnstile.operators.gold import exact_group_quantiles, fan_out, gold_facts, minute_labels, rolling_stats, row_labels
from turnstile.plans.incremental import read_gold_by_day, run_gold_by_day, state_path
from turnstile.session import work_path
from turnstile.showcase.common import MINUTES, ORACLES, minute_facts, query, seconds
from turnstile.sources.change_feed import change_stream, read_live
from turnstile.sources.tables import overwrite_changed, overwrite_partitions, read_table
from turnstile.streaming.materialize import start_materializer

HORIZONS = (10, 20, 30)
DIGITS = 4


def _union(template: str) -> str:
    return " UNION ALL ".join(template.format(h=h) for h in HORIZONS)


@query(
    "horizon_labels",
    f"WITH {MINUTES} "
    + _union(
        "SELECT event_type, minute_s, CAST({h} AS INTEGER) AS horizon_min, "
        "lead(score, {h}) OVER (PARTITION BY event_type ORDER BY minute) AS label_p50 FROM scored"
    ),
)
def horizon_labels(spark, folder, **options):
    series = minute_facts(spark, folder).select("event_type", "minute", "score")
    labelled = row_labels(series, ["event_type"], ["minute"], "score", HORIZONS, **options)
    spread = fan_out(labelled, {h: f"label_{h}" for h in HORIZONS})
    return spread.select("event_type", seconds("minute").alias("minute_s"), "horizon_min", "label_p50")


@query(
    "horizon_labels_minutes",
    f"WITH {MINUTES} "
    + _union(
        "SELECT a.event_type, a.minute_s, CAST({h} AS INTEGER) AS horizon_min, b.score AS label_p50 "
        "FROM scored a LEFT JOIN scored b ON a.event_type = b.event_type AND b.minute_s = a.minute_s + 60 * {h}"
    ),
)
def horizon_labels_minutes(spark, folder):
    series = minute_facts(spark, folder).select("event_type", "minute", "score")
    spread = minute_labels(series, ["event_type"], "minute", "score", HORIZONS)
    return spread.select("event_type", seconds("minute").alias("minute_s"), "horizon_min", "label_p50")


ROLLED = f"""
fixed AS (SELECT *, CAST(round(score * 1e{DIGITS}) AS BIGINT) AS x FROM scored),
sums AS (
  SELECT *, count(x) OVER w AS k, CAST(sum(x) OVER w AS HUGEINT) AS s, CAST(sum(x * x) OVER w AS HUGEINT) AS ss FROM fixed
  WINDOW w AS (PARTITION BY event_type ORDER BY minute RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)),
rolled AS (
  SELECT *, CAST(s AS DOUBLE) / k / 1e{DIGITS} AS rolling_mean_7d,
         round(sqrt(CAST(k * ss - s * s AS DOUBLE)) / k / 1e{DIGITS}, 6) AS rolling_std_7d FROM sums)
"""


@query("rolling_7d", f"WITH {MINUTES}, {ROLLED} SELECT event_type, minute_s, rolling_mean_7d, rolling_std_7d FROM rolled")
def rolling_7d(spark, folder, **options):
    series = minute_facts(spark, folder).select("event_type", "minute", "score")
    rolled = rolling_stats(series, ["event_type"], "minute", "score", digits=DIGITS, **options)
    return rolled.select(
        "event_type", seconds("minute").alias("minute_s"), "rolling_mean_7d", F.round("rolling_std_7d", 6).alias("rolling_std_7d")
    )


HIST = """
hist AS (
  SELECT event_type, quantile_disc(score, 0.5) AS hist_p50, quantile_disc(score, 0.9) AS hist_p90 FROM scored GROUP BY 1)
"""


@query(
    "hist_quantiles",
    f"WITH {MINUTES}, {HIST} SELECT s.event_type, minute_s, hist_p50, hist_p90 FROM scored s JOIN hist h ON s.event_type = h.event_type",
)
def hist_quantiles(spark, folder):
    series = minute_facts(spark, folder).select("event_type", "minute", "score")
    hist = exact_group_quantiles(series, ["event_type"], "score", {"hist_p50": 0.5, "hist_p90": 0.9})
    joined = series.join(hist, on="event_type", how="left")
    return joined.select("event_type", seconds("minute").alias("minute_s"), "hist_p50", "hist_p90")


def gold_rows(spark, folder, **options):
    series = minute_facts(spark, folder)
    options = {"exact_quantiles": True, "digits": DIGITS} | options
    return gold_facts(series, ["event_type"], "minute", "score", HORIZONS, **options)


GOLD = (
    f"{MINUTES}, {ROLLED}, {HIST}, gold AS ("
    + _union(
        "SELECT r.event_type, minute, minute_s, active_users, avg_value, score, CAST({h} AS INTEGER) AS horizon_min, "
        "lead(score, {h}) OVER (PARTITION BY r.event_type ORDER BY minute) AS label_p50, "
        "rolling_mean_7d, rolling_std_7d, hist_p50, hist_p90, strftime(minute, '%Y-%m-%d') AS day "
        "FROM rolled r LEFT JOIN hist h ON r.event_type = h.event_type"
    )
    + ")"
)


def shown(facts):
    return facts.select(
        "event_type",
        seconds("minute").alias("minute_s"),
        "active_users",
        "avg_value",
        "score",
        "horizon_min",
        "label_p50",
        "rolling_mean_7d",
        F.round("rolling_std_7d", 6).alias("rolling_std_7d"),
        "hist_p50",
        "hist_p90",
        F.date_format("date", "yyyy-MM-dd").alias("day"),
    )


@query("gold_fact", f"WITH {GOLD} SELECT * EXCLUDE (minute) FROM gold")
def gold_fact(spark, folder):
    return shown(gold_rows(spark, folder))


# The same with slices of a thousand rows, so that every series is hot.
SLICE = 1000


@query("horizon_labels_sliced", ORACLES["horizon_labels"])
def horizon_labels_sliced(spark, folder):
    return horizon_labels(spark, folder, rows_per_slice=SLICE)


@query("rolling_7d_sliced", ORACLES["rolling_7d"])
def rolling_7d_sliced(spark, folder):
    return rolling_7d(spark, folder, rows_per_slice=SLICE)


@query("gold_fact_sliced", ORACLES["gold_fact"])
def gold_fact_sliced(spark, folder):
    return shown(gold_rows(spark, folder, rows_per_slice=SLICE))


@query("gold_fact_sketch", ORACLES["gold_fact"])
def gold_fact_sketch(spark, folder):
    """With the quantile sketch that the job uses, at an accuracy above the rows of a series."""
    return shown(gold_rows(spark, folder, exact_quantiles=False, accuracy=1_000_000))


@query("gold_incremental", f"WITH {GOLD} SELECT * EXCLUDE (minute) FROM gold")
def gold_incremental(spark, folder):
    """Gold stored from the first half of the dates, then brought up to date partition by partition."""
    path = f"{work_path(spark, 'gold')}/gold"
    series = minute_facts(spark, folder)
    for part in (series.filter(F.col("minute") < F.lit("2024-01-15").cast("timestamp")), series):
        facts = gold_facts(part, ["event_type"], "minute", "score", HORIZONS, exact_quantiles=True, digits=DIGITS)
        overwrite_changed(facts, path, ["date", "horizon_min"])
    stored = read_table(spark, path)
    return shown(stored.withColumn("horizon_min", F.col("horizon_min").cast("int")))


#: Holds all rows of a series, so that merged sketches are exact.
WIDE_SKETCH = 65_535
BY_DAY = {"keys": ["event_type"], "score": "score", "horizons": HORIZONS, "digits": DIGITS, "sketch": WIDE_SKETCH}


def kept_by_day(spark, folder, after=None):
    """Gold by the day: from the first half of the dates, then from all; ``after`` is called after each run."""
    root = work_path(spark, "by-day")
    series = minute_facts(spark, folder).withColumn("date", F.to_date("minute"))
    early = F.col("minute") < F.lit("2024-01-15").cast("timestamp")
    for part in (series.filter(early), series.filter(~early)):
        overwrite_partitions(part, f"{root}/silver", ["date"])
        run_gold_by_day(spark, f"{root}/silver", f"{root}/gold", **BY_DAY)
        if after:
            after(root)
    return root


@query("gold_by_day", f"WITH {GOLD} SELECT * EXCLUDE (minute) FROM gold")
def gold_by_day(spark, folder):
    return shown(read_gold_by_day(spark, f"{kept_by_day(spark, folder)}/gold", ["event_type"]))


@query(
    "gold_change_feed",
    f"""WITH {GOLD} SELECT event_type, minute_s, score, horizon_min, label_p50, rolling_mean_7d, hist_p50, hist_p90 FROM gold
    QUALIFY row_number() OVER (PARTITION BY event_type, horizon_min ORDER BY minute DESC) = 1""",
)
def gold_change_feed(spark, folder):
    """The snapshot that a stream over the feed of changes leaves after both runs."""
    keys = ["event_type", "horizon_min"]

    def follow(root):
        stream = change_stream(spark, state_path(f"{root}/gold", "changes"))
        start_materializer(stream, f"{root}/log", f"{root}/seen", keys=keys, order=("version",), available_now=True).awaitTermination()

    live = read_live(spark, f"{kept_by_day(spark, folder, follow)}/log", keys)
    return live.select(
        "event_type", seconds("minute").alias("minute_s"), "score", "horizon_min", "label_p50", "rolling_mean_7d", "hist_p50", "hist_p90"
    )


@query("merged_sketches", f"WITH {MINUTES}, {HIST} SELECT * FROM hist")
def merged_sketches(spark, folder):
    """Quantiles from one sketch per series and day, as exact as the sketch is wide."""
    series = minute_facts(spark, folder).select("event_type", "minute", "score")
    totals = day_totals(series, ["event_type"], "minute", "score", DIGITS, WIDE_SKETCH)
    return merged_quantiles(totals, ["event_type"], {"hist_p50": 0.5, "hist_p90": 0.9})


#: Rank error that a sketch of SKETCH values keeps to with high confidence.
RANK_ERROR = 2.446 / SKETCH**0.9433


@query(
    "sketch_rank_error",
    f"WITH {MINUTES} SELECT event_type, p, count(*) AS n, true AS within FROM scored, (SELECT unnest([0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS p) GROUP BY ALL",
)
def sketch_rank_error(spark, folder):
    """Whether the true rank of each merged quantile is as close as the sketch size says."""
    series = minute_facts(spark, folder).select("event_type", "minute", "score")
    probs = {f"q{i}": p for i, p in enumerate((0.1, 0.5, 0.9, 0.99))}
    found = merged_quantiles(day_totals(series, ["event_type"], "minute", "score", DIGITS), ["event_type"], probs)
    found = found.select("event_type", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(q).alias("q")) for q, p in probs.items()])).alias("e"))
    ranked = series.join(found.select("event_type", "e.*"), "event_type").groupBy("event_type", "p")
    counted = ranked.agg(F.count("*").alias("n"), F.count_if(F.col("score") < F.col("q")).alias("below"), F.count_if(F.col("score") <= F.col("q")).alias("upto"))
    near = (F.col("below") <= (F.col("p") + RANK_ERROR) * F.col("n")) & (F.col("upto") >= (F.col("p") - RANK_ERROR) * F.col("n"))
    return counted.select("event_type", "p", "n", near.alias("within"))
