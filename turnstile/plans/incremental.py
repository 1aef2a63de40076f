"""Gold kept up to date by the day (B2, T4): only what a changed day of Silver reaches is computed.

Below the Gold path lie ``facts`` (rows without historic quantiles, by date and
horizon), the state of ``operators/carried.py`` by day (``totals``, ``heads``), the
quantiles per series, the newest row per series and horizon, the feed of its
changes, and ``days``: which files each day of Silver had. A day counts as changed
when its files differ, so writers need to report nothing and a day of late rows is
found like any other. ``days`` is written last: a run that breaks off is done again.
"""

from __future__ import annotations

import datetime
import hashlib
from collections import defaultdict
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.operators.carried import (
    SKETCH,
    dated_facts,
    day_heads,
    day_totals,
    looking_back,
    merged_quantiles,
    reached_days,
)
from turnstile.operators.gold import WEEK
from turnstile.operators.slices import ROWS_PER_SLICE, _same
from turnstile.plans import transit
from turnstile.plans.batch import run_silver
from turnstile.session import remove_work, work_path
from turnstile.sources.change_feed import append_changes, row_changes
from turnstile.sources.tables import overwrite_partitions

PROBS = {"hist_p50": 0.5, "hist_p90": 0.9}
_EPOCH = datetime.date(1970, 1, 1)


def state_path(gold: str, name: str) -> str:
    return f"{gold}/{name}"


def day_files(spark: SparkSession, path: str) -> dict[int, str]:
    """A digest of the file names of each ``date=`` folder; nothing is read but the listing."""
    names = defaultdict(list)
    for file in spark.read.parquet(path).inputFiles():
        for part in file.split("/"):
            if part.startswith("date=") and part[5:9].isdigit():
                names[(datetime.date.fromisoformat(part[5:]) - _EPOCH).days].append(file.rsplit("/", 1)[1])
    return {day: hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest() for day, found in names.items()}


def run_silver_by_day(spark: SparkSession, root: str, **options) -> list[str]:
    """Compute Silver anew for the dates whose Bronze files changed, each date for itself; returns them.

    Late rows land below their own date, so they bring that date back, and no other.
    What was seen is noted last: a run that breaks off does its dates again.
    """
    place = f"{root}/silver_days"
    log = _read(spark, place)
    known = {(r.topic, r.day): r.files for r in log.collect()} if log is not None else {}
    now = {}
    for topic in (transit.VEHICLES, transit.UPDATES, transit.WEATHER):
        now |= {(topic, day): files for day, files in day_files(spark, transit.bronze_path(root, topic)).items()}
    dates = [str(d) for d in _dates({day for (topic, day), files in now.items() if known.get((topic, day)) != files})]
    for date in dates:
        run_silver(spark, root, date=date, **options)
    if dates:
        rows = [(topic, day, files) for (topic, day), files in now.items()]
        spark.createDataFrame(rows, "topic string, day long, files string").coalesce(1).write.mode("overwrite").parquet(place)
    return dates


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def _dates(days: Sequence[int]) -> list[datetime.date]:
    return [_EPOCH + datetime.timedelta(int(d)) for d in sorted(days)]


def on_days(rows: DataFrame, days: Sequence[int]) -> DataFrame:
    """The rows of these days; a partition filter, so other dates are not read."""
    return rows.filter(F.col("date").isin(_dates(days)))


def run_gold_by_day(
    spark: SparkSession,
    silver: str,
    gold: str,
    *,
    keys: Sequence[str] = transit.SERIES,
    minute: str = "minute",
    score: str = "crowding_score",
    horizons: Sequence[int] = transit.HORIZONS,
    digits: int = 6,
    sketch: int = SKETCH,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> dict[str, list[int]]:
    """Bring Gold up to date with Silver; returns the days that changed, those computed and those that are gone.

    Days are computed if their Silver changed, if their rolling window holds rows of
    a changed day, or if their labels reach one. Of Silver these days are read, and
    the days that leave their windows, a week before. Keys, score, horizons and
    digits must stay the same for one Gold path.
    """
    keys, horizons = list(keys), [int(h) for h in horizons]
    reach, place = max(horizons), lambda name: state_path(gold, name)
    now = day_files(spark, silver)
    log = _read(spark, place("days"))
    known = {r.day: r for r in log.collect()} if log is not None else {}
    version = max([r.version for r in known.values()], default=0) + 1
    changed = sorted(d for d, files in now.items() if d not in known or known[d].files != files)
    gone = sorted(d for d in known if d not in now and known[d].filled)
    if not changed and not gone:
        return {"changed": [], "computed": [], "gone": []}
    source = spark.read.parquet(silver)
    staged = work_path(spark, "gold-state")
    try:
        fresh = on_days(source, changed)
        day_totals(fresh, keys, minute, score, digits, sketch).write.parquet(f"{staged}/totals")
        day_heads(fresh, keys, minute, score, reach).write.parquet(f"{staged}/heads")
        new_totals, new_heads = spark.read.parquet(f"{staged}/totals"), spark.read.parquet(f"{staged}/heads")
        filled = {r.day for r in new_totals.select("day").distinct().collect()}
        stale = [*changed, *gone]
        old = _read(spark, place("totals"))
        valid = [d for d, r in known.items() if r.filled]
        old = new_totals.limit(0) if old is None else old.select(new_totals.columns).filter(F.col("day").isin(valid))
        heads = _read(spark, place("heads"))
        heads = new_heads.limit(0) if heads is None else heads.select(new_heads.columns).filter(F.col("day").isin(valid))
        totals = old.filter(~F.col("day").isin(stale)).unionByName(new_totals)
        heads = heads.filter(~F.col("day").isin(stale)).unionByName(new_heads)

        reached = reached_days(totals, keys, stale, reach).union(reached_days(old, keys, stale, reach)).distinct()
        present = {d for d in now if d in filled or (d in known and known[d].filled and d not in stale)}
        computed = sorted((looking_back(stale) | {r.day for r in reached.collect()}) & present)
        needed = {d - back for d in computed for back in (0, WEEK // (24 * 3600))} & set(now)
        facts = dated_facts(
            on_days(source, needed).drop("date"), totals, heads, computed, keys, minute, score, horizons, digits=digits, rows_per_slice=rows_per_slice
        )
        overwrite_partitions(facts.withColumn("date", F.to_date(minute)), place("facts"), ["date", "horizon_min"])

        quantiles = merged_quantiles(totals, keys, PROBS)
        quantiles.write.parquet(f"{staged}/quantiles")
        touched = new_totals.select(keys).union(old.filter(F.col("day").isin(stale)).select(keys)).distinct()
        _publish(spark, gold, f"{staged}/newest", touched, totals, spark.read.parquet(f"{staged}/quantiles"), keys, minute, version)

        overwrite_partitions(new_totals, place("totals"), ["day"])
        overwrite_partitions(new_heads, place("heads"), ["day"])
        spark.read.parquet(f"{staged}/quantiles").write.mode("overwrite").parquet(place("quantiles"))
        spark.read.parquet(f"{staged}/newest").write.mode("overwrite").parquet(place("newest"))
        rows = [(d, files, d in present, version) for d, files in now.items()]
        spark.createDataFrame(rows, "day long, files string, filled boolean, version long").coalesce(1).write.mode("overwrite").parquet(place("days"))
    finally:
        remove_work(spark, staged)
    return {"changed": changed, "computed": computed, "gone": gone}


def _publish(spark, gold, staged, touched, totals, quantiles, keys, minute, version) -> None:
    """Stage the newest row of every series and horizon, and append what changed in it to the feed.

    Only series with rows on a changed day can differ; theirs are read again, from
    the day that is their last.
    """
    ends = _same(totals, touched, keys, "left_semi").groupBy(*keys).agg(F.max("day").alias("day"))
    days = [r.day for r in ends.select("day").distinct().collect()]
    facts = on_days(spark.read.parquet(state_path(gold, "facts")), days)
    last = _same(facts, ends.select(*keys, F.date_from_unix_date(F.col("day").cast("int")).alias("date")), [*keys, "date"], "left_semi")
    newest = last.groupBy(*keys, "horizon_min").agg(F.max_by(F.struct(*last.columns), minute).alias("row")).select("row.*")
    newest = newest.join(quantiles.dropna(subset=keys), keys, "left")
    old = _read(spark, state_path(gold, "newest"))
    old = newest.limit(0) if old is None else old.select(newest.columns)
    newest.unionByName(_same(old, touched, keys, "left_anti")).write.parquet(staged)
    mine = _same(spark.read.parquet(staged), touched, keys, "left_semi")
    changes = row_changes(_same(old, touched, keys, "left_semi"), mine, [*keys, "horizon_min"])
    append_changes(changes, state_path(gold, "changes"), version)


def read_gold_by_day(spark: SparkSession, gold: str, keys: Sequence[str] = transit.SERIES) -> DataFrame:
    """The fact table: the stored rows of all days of Silver with the quantiles of their series."""
    days = [r.day for r in spark.read.parquet(state_path(gold, "days")).filter("filled").collect()]
    facts = on_days(spark.read.parquet(state_path(gold, "facts")), days)
    quantiles = spark.read.parquet(state_path(gold, "quantiles")).dropna(subset=list(keys))
    return facts.join(quantiles, list(keys), "left").withColumn("horizon_min", F.col("horizon_min").cast("int"))
