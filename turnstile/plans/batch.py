"""Batch jobs: Silver, Gold, validation, layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from turnstile.operators.gold import gold_facts
from turnstile.operators.quality import Check, between, enforce, more_rows_than, not_null, run_checks
from turnstile.operators.silver import silver_facts
from turnstile.plans import transit
from turnstile.sources.tables import overwrite_changed, read_dimension, read_table, write_checked


def silver_checks() -> list[Check]:
    return [not_null("h3"), between("active_trips", low=0)]


def build_silver(
    spark: SparkSession,
    root: str,
    *,
    schedule: str | None = None,
    date: str | None = None,
    resolution: int = 8,
    backend: str = "hex",
    dedupe: str | None = None,
    schema_root: str | None = None,
) -> DataFrame:
    """Silver rows from the Bronze tables; ``date`` prunes every Bronze scan.

    Bronze is read with the optional fields of its topics' contracts, of
    ``schema_root`` if given, so rows from before a contract grew are read with those
    from after it.
    """
    schedule = schedule or transit.schedule_root(root)

    def bronze(topic: str) -> DataFrame:
        return read_table(spark, transit.bronze_path(root, topic), date, contract=transit.contract(spark, topic, schema_root))

    return silver_facts(
        bronze(transit.VEHICLES),
        bronze(transit.UPDATES),
        bronze(transit.WEATHER),
        read_dimension(spark, schedule, "stop_times"),
        read_dimension(spark, schedule, "stops"),
        resolution=resolution,
        backend=backend,
        dedupe=dedupe,
    )


def run_silver(spark: SparkSession, root: str, *, on_fail: str = "raise", **options) -> str:
    """Build, check and store Silver; returns its path.

    The rows are computed and written once: the checks are observed on the write, and
    the dates at hand are swapped in by renaming only if they hold, so a failed check
    leaves Silver as it was. ``on_fail="quarantine"`` stores the good rows and puts the
    bad ones next to the table.
    """
    if on_fail not in ("raise", "quarantine"):
        raise ValueError(f"unknown on_fail mode: {on_fail}")
    bad = f"{root}/quarantine/silver" if on_fail == "quarantine" else None
    write_checked(build_silver(spark, root, **options), transit.silver_path(root), "date", silver_checks(), "silver", bad)
    return transit.silver_path(root)


def run_gold(spark: SparkSession, root: str, horizons: Sequence[int] = transit.HORIZONS, **options) -> str:
    """Compute Gold from all of Silver and replace the partitions that changed.

    The quantiles cover the whole series, so any row may change with any date;
    but the table, and so the stream that follows it, gets only the changes. On
    unchanged Silver nothing is written.
    """
    silver = read_table(spark, transit.silver_path(root))
    facts = gold_facts(silver, transit.SERIES, horizons=horizons, **options)
    overwrite_changed(facts, transit.gold_path(root), ["date", "horizon_min"])
    return transit.gold_path(root)


def validate_tables(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Row-count check of each table; raises if one is empty."""
    results = None
    for name, path in tables.items():
        result = run_checks(read_table(spark, path), name, [more_rows_than(0)])
        results = result if results is None else results.unionByName(result)
    return spark.createDataFrame(enforce(results), results.schema)
