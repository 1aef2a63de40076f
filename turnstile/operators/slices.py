"""Ordered calculations per key that never put a hot key into one task.

A plain window by key sorts all rows of a key in one task. That is the best
plan for ordinary keys and a stalled job for a key that holds a third of the
table. Here the hot keys, and only they, are cut into *slices*:

- one narrow aggregate counts the rows of each key; if no key has more than
  ``rows_per_slice``, the plain window is the whole plan;
- else the hot rows are dealt out by ranges of (key, order columns), which
  Spark takes from a sample of these rows, sorted, cut into slices of
  ``rows_per_slice`` rows and checkpointed. A range is a task and holds many slices
  if these are small: tasks follow from the rows, so small slices do not flood the
  driver with tasks. Any sortable columns will do, outliers do not widen a slice,
  and rows that tie in the first order column are cut along the further ones;
- each slice gets one extra row with the running totals before it, and copies of
  the few rows just outside it that a window looks at;
- one window by (key, slice) then finishes the work in one wide shuffle.

Ordinary keys have the one slice 0 and need no extra rows. The input is read once
for the counts and once for the rows; what follows reads the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from turnstile.session import shared_folder

ROWS_PER_SLICE = 1_000_000
# A task's rows at most, if slices are smaller.
ROWS_PER_TASK = 200_000
# Ranges beyond the even share: bounds come from a sample, so sizes vary.
FINER = 2

_ALL = "__all"


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str, hint=lambda df: df) -> DataFrame:
    """Join on equal columns where null equals null, as in a window."""
    marked = right.withColumnsRenamed({c: f"__right_{c}" for c in columns})
    met = F.lit(True)
    for c in columns:
        met = met & F.col(c).eqNullSafe(F.col(f"__right_{c}"))
    return left.join(hint(marked), on=met, how=how).drop(*[f"__right_{c}" for c in columns])


def _hot_keys(df: DataFrame, keys: Sequence[str], rows_per_slice: int) -> tuple[DataFrame, int]:
    """The keys with more rows than a slice, and how many rows they have together."""
    shared_folder(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > rows_per_slice).checkpoint()
    return counts, counts.agg(F.sum("__rows")).first()[0] or 0


def _ranges(df: DataFrame, n_rows: int, rows_per_slice: int) -> int:
    """How many ranges the hot rows are dealt out to: a slice each, or a task's fill of smaller slices; a range per core at least."""
    slices, fills = (math.ceil(n_rows * FINER / rows) for rows in (rows_per_slice, max(rows_per_slice, ROWS_PER_TASK)))
    return min(slices, max(fills, df.sparkSession.sparkContext.defaultParallelism))


def _deal(df: DataFrame, hot: DataFrame, n_rows: int, keys: Sequence[str], order: Sequence[str], rows_per_slice: int):
    """The rows of ordinary keys in slice 0, and the checkpointed rows of hot keys in slices from 1 on."""
    marked = _same(df, hot.select(*keys, F.lit(True).alias("__hot")), keys, "left")
    marked = marked.withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    along = [F.col(c) for c in dict.fromkeys([*keys, *order])]
    dealt = marked.filter("__hot").repartitionByRange(_ranges(df, n_rows, rows_per_slice), *along).sortWithinPartitions(*along)
    # Ids ascend along the ranges and, within one, along its rows; rows that tie take the first one's, and so its slice.
    # The ranges hold such rows together: no shuffle.
    dealt = dealt.withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__at", F.min("__at").over(Window.partitionBy(*along)))
    dealt = dealt.withColumn("__slice", F.expr(f"__at div {rows_per_slice}L + 1")).drop("__at").checkpoint()
    return marked.filter(~F.col("__hot")).withColumn("__slice", F.lit(0).cast("long")), dealt


def _key_rows(per_key: DataFrame, dealt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key, once for every slice the key has."""
    slices = dealt.select(*keys, "__slice").distinct()
    return _same(per_key, slices, keys, "left").withColumn("__slice", F.coalesce("__slice", F.lit(0).cast("long")))


def _starts(rows: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One row per slice of a hot key: the totals of the slices before it."""
    sums = rows.groupBy(*keys, "__slice").agg(*[F.sum(p).alias(p) for p in parts])
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "__slice", *[F.sum(p).over(earlier).alias(p) for p in parts])


def _borrowed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int) -> DataFrame:
    """Copies of the rows just outside each slice of a hot key.

    Rows are matched by their position in the key, which follows from the row
    counts of the slices; only the first and last few rows of a slice take part.
    """
    whole = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        rows.groupBy(*keys, "__slice")
        .agg(F.count("*").alias("__n"))
        .withColumn("__end", F.sum("__n").over(whole))
        .withColumn("__start", F.col("__end") - F.col("__n"))
    )
    inside = Window.partitionBy(*keys, "__slice")
    sides = []
    if after:
        rank = F.row_number().over(inside.orderBy(*order))
        sides.append((rank, after, F.col("__start") + F.col("__rank"), F.col("__end") + F.col("__i")))
    if before:
        rank = F.row_number().over(inside.orderBy(*[F.col(c).desc() for c in order]))
        sides.append((rank, before, F.col("__end") - F.col("__rank") + 1, F.col("__start") - F.col("__i") + 1))
    found = None
    for rank, reach, position, wanted in sides:
        edge = rows.withColumn("__rank", rank).filter(F.col("__rank") <= reach)
        edge = _same(edge, ends, [*keys, "__slice"], "inner").withColumn("__position", position)
        needs = ends.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn("__position", wanted)
        needs = needs.select(*keys, "__position", F.col("__slice").alias("__target"))
        copies = _same(edge, needs, [*keys, "__position"], "inner").withColumn("__slice", F.col("__target"))
        copies = copies.select(*rows.columns)
        found = copies if found is None else found.unionByName(copies)
    return found


def sliced_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    totals: dict[str, Column] | None = None,
    ties: bool = True,
    keep: Column | None = None,
    near: Callable[[WindowSpec], dict[str, Column]] | None = None,
    before: int = 0,
    after: int = 0,
    per_key: DataFrame | None = None,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Add window columns per key; equal to the plain window by ``keys``.

    ``totals`` are summed from the start of the key up to the row. With ``ties``
    rows that are equal in ``order`` share one total (a RANGE frame); without,
    each row counts on its own (ROWS). ``near`` gets a window and returns
    columns that look at most ``before`` rows back and ``after`` ahead; for it,
    and in the result, only the rows that ``keep`` remain. Without ties, and for
    ``near``, ``order`` should be total. ``per_key`` holds at most one row per
    key; its other columns are added as a left join would, on the same shuffle.
    The search for hot keys runs when this is called; ``rows_per_slice=None``
    skips it: the plain window, for keys that are known to be small. With ties,
    rows that are equal in all of ``order`` share a slice.
    """
    totals = totals or {}
    parts = {name: f"__part_{name}" for name in totals}
    given = df if keys else df.withColumn(_ALL, F.lit(0))
    keys = list(keys) or [_ALL]
    rows = given.withColumns({parts[name]: value for name, value in totals.items()})
    search = rows_per_slice is not None
    if search:
        hot, n_rows = _hot_keys(rows, keys, rows_per_slice)
        search = n_rows > 0
    if search:
        cold, dealt = _deal(rows, hot, n_rows, keys, order, rows_per_slice)
        rows = cold.unionByName(dealt)
    else:
        rows = rows.withColumns({"__hot": F.lit(False), "__slice": F.lit(0).cast("long")})
    # Start rows sort before all others of their slice.
    merged = rows.withColumns({"__own": F.lit(True), "__after_start": F.lit(True)})
    if near is not None and search and (before or after):
        kept = dealt if keep is None else dealt.filter(keep)
        copies = _borrowed(kept, keys, order, before, after).drop(*parts.values())
        copies = copies.withColumns({"__own": F.lit(False), "__after_start": F.lit(True)})
        merged = merged.unionByName(copies, allowMissingColumns=True)
    starts = []
    if totals and search:
        starts.append(_starts(dealt, keys, list(parts.values())))
    if per_key is not None:
        key_rows = _key_rows(per_key, dealt, keys) if search else per_key.withColumn("__slice", F.lit(0).cast("long"))
        starts.append(key_rows)
    for start in starts:
        start = start.withColumns({"__own": F.lit(False), "__after_start": F.lit(False)})
        merged = merged.unionByName(start, allowMissingColumns=True)
    if totals or starts:
        window = Window.partitionBy(*keys, "__slice").orderBy("__after_start", *order)
        upto = (window.rangeBetween if ties else window.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
        running = {name: F.sum(part).over(upto) for name, part in parts.items()}
        if per_key is not None:
            running |= {c: F.first(c, ignorenulls=True).over(upto) for c in per_key.columns if c not in keys}
        merged = merged.withColumns(running).filter("__after_start")
    if keep is not None:
        merged = merged.filter(keep)
    if near is not None:
        # The same sort order as above, so no further sort or shuffle.
        merged = merged.withColumns(near(Window.partitionBy(*keys, "__slice", "__after_start").orderBy(*order)))
    return merged.filter("__own").drop("__hot", "__slice", "__own", "__after_start", _ALL, *parts.values())


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Add the 1-based row number per key; equals ``row_number`` by key."""
    one = {name: F.lit(1).cast("long")}
    return sliced_window(df, keys, order, totals=one, ties=False, rows_per_slice=rows_per_slice)
