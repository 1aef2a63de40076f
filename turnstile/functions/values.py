"""Casts, defaults and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def as_number(value: Column) -> Column:
    """Double, or null where the text is no number (ANSI casts would fail)."""
    return value.try_cast("double")


def number_or_zero(value: Column) -> Column:
    return F.coalesce(as_number(value), F.lit(0.0))


def number_and_text(value: Column) -> tuple[Column, Column]:
    """A mixed value as two typed columns: the number, or the text kept as is."""
    number = as_number(value)
    return number, F.when(number.isNull(), value.cast("string"))


def published_number(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def published_text(value: Column) -> Column:
    """Null or empty text becomes "unknown"."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(UNKNOWN))


def blank_if_absent(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def zero_if_absent(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(0).cast("long"))


def stamp_or_now(epoch: Column, now: Column | None = None) -> Column:
    """Epoch seconds; an absent or zero stamp means "now"."""
    return F.coalesce(F.nullif(epoch.cast("long"), F.lit(0).cast("long")), F.unix_timestamp() if now is None else now)


def feature_key(origin: Column, dest: Column, horizon: Column) -> Column:
    return F.concat_ws(":", origin, dest, horizon.cast("string"))


def split_feature_key(key: Column) -> dict[str, Column]:
    """Parts of a feature key. Ids that hold ":" cannot be told apart; keep the
    typed columns next to the key as the truth."""
    parts = F.split(key, ":")
    return {
        "origin_stop": F.get(parts, F.lit(0)),
        "dest_stop": F.get(parts, F.lit(1)),
        "horizon_min": F.get(parts, F.lit(2)).try_cast("int"),
    }


def series_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def same_text(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def is_numeric_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9]+$"), F.lit(False))


def is_platform(stop_id: Column) -> Column:
    """All-digit ids, and ids that begin with 7 and four more digits."""
    return F.coalesce(stop_id.rlike(r"^([0-9]+$|7[0-9]{4})"), F.lit(False))


def has_prefix(value: Column, prefix: str) -> Column:
    return F.coalesce(value.startswith(prefix), F.lit(False))


def valid_horizon(horizon: Column, low: int = 5, high: int = 120) -> Column:
    return F.coalesce(horizon.between(low, high), F.lit(False))


def to_payload(**fields: Column) -> Column:
    """Payload as JSON text, null fields left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def from_payload(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
