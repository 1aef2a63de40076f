"""Data-quality checks, all on one pass (Q1-Q4)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from turnstile.operators.curate import split_rows


@dataclass(frozen=True)
class Check:
    """A named check; ``valid`` is true for good rows, None checks the row count."""

    name: str
    column: str
    valid: Column | None = None
    min_rows: int = 0


def not_null(column: str) -> Check:
    return Check("not_null", column, F.col(column).isNotNull())


def between(column: str, low=None, high=None) -> Check:
    """Inclusive bounds; nulls pass."""
    valid = F.lit(True)
    if low is not None:
        valid = valid & (F.col(column) >= F.lit(low))
    if high is not None:
        valid = valid & (F.col(column) <= F.lit(high))
    return Check("between", column, F.coalesce(valid, F.lit(True)))


def more_rows_than(value: int = 0) -> Check:
    return Check("more_rows_than", "*", None, value)


def run_checks(df: DataFrame, table: str, checks: Sequence[Check]) -> DataFrame:
    """One result row per check from a single aggregate over the table."""
    counts = [
        F.count_if(~c.valid).alias(f"bad_{i}") if c.valid is not None else F.lit(0).cast("long").alias(f"bad_{i}")
        for i, c in enumerate(checks)
    ]
    totals = df.agg(F.count("*").alias("rows"), *counts)
    results = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c.name).alias("check_name"),
            F.lit(c.column).alias("column_name"),
            F.col("rows").alias("row_count"),
            F.col(f"bad_{i}").alias("failed"),
            (F.col(f"bad_{i}") == 0 if c.valid is not None else F.col("rows") > c.min_rows).alias("success"),
        )
        for i, c in enumerate(checks)
    ]
    return totals.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def observed(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, Observation]:
    """The rows, and what the checks count of them while they are written: one pass for both."""
    seen = Observation()
    counts = [F.count_if(~F.coalesce(c.valid, F.lit(False))).alias(f"bad_{i}") for i, c in enumerate(checks) if c.valid is not None]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def enforce_observed(seen: Observation, table: str, checks: Sequence[Check]) -> list[dict]:
    """The result of each check as ``run_checks`` gives it, once the rows are written; raises ``ValueError`` if one failed."""
    counts, results = seen.get, []
    for i, c in enumerate(checks):
        failed = counts[f"bad_{i}"] if c.valid is not None else 0
        success = failed == 0 if c.valid is not None else counts["rows"] > c.min_rows
        results.append(
            {"table_name": table, "check_name": c.name, "column_name": c.column, "row_count": counts["rows"], "failed": failed, "success": success}
        )
    failures = [r for r in results if not r["success"]]
    if failures:
        raise ValueError(f"data quality checks failed: {failures}")
    return results


def enforce(results: DataFrame) -> list:
    """Raise ``ValueError`` if a check failed; else return the result rows (one
    per check)."""
    rows = results.collect()
    failed = [r for r in rows if not r["success"]]
    if failed:
        raise ValueError(f"data quality checks failed: {[r.asDict() for r in failed]}")
    return rows


def passes_all(checks: Sequence[Check]) -> Column:
    valid = F.lit(True)
    for check in checks:
        if check.valid is not None:
            valid = valid & check.valid
    return valid


def quarantine(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that pass all row checks and the others."""
    return split_rows(df, passes_all(checks))
