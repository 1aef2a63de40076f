"""Columns a map or panel shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds, names, map colours (RGBA) and panel colours.
LEVELS = [
    (0.25, "Low", (16, 185, 129, 200), "#10b981"),
    (0.5, "Moderate", (245, 158, 11, 200), "#f59e0b"),
    (0.75, "High", (249, 115, 22, 200), "#f97316"),
    (None, "Very High", (239, 68, 68, 200), "#ef4444"),
]


def _by_level(score: Column, values: list[Column]) -> Column:
    chain = None
    for (bound, *_), value in zip(LEVELS, values):
        if bound is None:
            return chain.otherwise(value)
        chain = F.when(score < bound, value) if chain is None else chain.when(score < bound, value)
    raise AssertionError("the last level has no bound")


def crowding_level(score: Column) -> Column:
    return _by_level(score, [F.lit(name) for _, name, _, _ in LEVELS])


def crowding_colour(score: Column) -> Column:
    return _by_level(score, [F.lit(colour) for _, _, _, colour in LEVELS])


def crowding_rgba(score: Column) -> Column:
    return _by_level(score, [F.array(*[F.lit(v) for v in rgba]) for _, _, rgba, _ in LEVELS])


def marker_radius(score: Column) -> Column:
    return F.lit(300.0) + score * F.lit(500.0)


def percent(score: Column) -> Column:
    return F.round(score * 100.0, 0).cast("long")


def gauge_position(score: Column) -> Column:
    return F.least(score * 100.0, F.lit(98.0))
