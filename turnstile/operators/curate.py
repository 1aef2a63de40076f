"""Filters, projections and checks on columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions.values import published_text


def split_rows(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Route each row once: where ``good`` is true, and where it is false or null."""
    flag = F.coalesce(good, F.lit(False))
    return df.filter(flag), df.filter(~flag)


def expand_struct(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(f"{column}.*", *keep)


def on_date(df: DataFrame, column: str, day: str | date | None) -> DataFrame:
    """Rows of one date; all rows for ``None``. A typed literal prunes partitions."""
    return df if day is None else df.filter(F.col(column) == F.lit(str(day)).cast("date"))


def on_horizon(df: DataFrame, horizon: int, column: str = "horizon_min") -> DataFrame:
    return df.filter(F.col(column) == F.lit(int(horizon)))


def in_time_range(
    df: DataFrame,
    column: str,
    start: str | None = None,
    end: str | None = None,
    date_column: str | None = None,
) -> DataFrame:
    """Rows with start <= column <= end; either bound may be missing.

    The literals are cast, not the column, so the filter reaches the scan. A
    ``date_column`` that partitions the table is bounded too.
    """
    for bound, keep in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is None:
            continue
        stamp = F.lit(bound).cast("timestamp")
        df = df.filter(keep(F.col(column), stamp))
        if date_column:
            df = df.filter(keep(F.col(date_column), stamp.cast("date")))
    return df


def cast_numbers(df: DataFrame, columns: Sequence[str], to: str = "double") -> DataFrame:
    """Cast columns; values that do not fit become null, as without ANSI mode."""
    return df.withColumns({c: F.col(c).try_cast(to) for c in columns})


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null text becomes "unknown" (empty text stays)."""
    return df.fillna({c: "unknown" for c in columns})


def publishable(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Null numbers become 0.0; null or empty texts become "unknown"."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers}
        | {c: published_text(F.col(c)) for c in texts}
    )


def rename_role(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A dimension under another role: pick and rename its columns."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def pick_features(df: DataFrame, preferred: Sequence[str], excluded: Sequence[str]) -> list[str]:
    """Preferred columns the table has; if none, all that are not excluded."""
    found = [c for c in preferred if c in df.columns]
    found = found or [c for c in df.columns if c not in set(excluded)]
    if not found:
        raise ValueError("no feature columns available")
    return found


def default_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill absent features only; columns the table lacks are added."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
            for name, value in defaults.items()
        }
    )
