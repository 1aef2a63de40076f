"""Feature snapshots and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.values import UNKNOWN, has_prefix, is_platform
from turnstile.operators.curate import default_missing

KEY = ("origin_stop", "dest_stop", "horizon_min")
# The model's features and what stands in for a missing one.
FEATURES = ("active_trips", "avg_departure_delay_s", "rolling_mean_7d", "hist_p50", "hist_p90")
DEFAULTS = {name: 0.0 for name in FEATURES} | {"h3": UNKNOWN}


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, which should be total.

    An aggregate, so each task first keeps one row per key.
    """
    newest = F.max_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("__last")).select(*keys, "__last.*")


def fresh_rows(df: DataFrame, updated_at: str, ttl_seconds: int, now: Column) -> DataFrame:
    """Rows not older than the time to live; 0 keeps all."""
    if not ttl_seconds:
        return df
    return df.filter(F.col(updated_at) > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def lookup(
    requests: DataFrame,
    snapshot: DataFrame,
    keys: Sequence[str] = KEY,
    defaults: dict[str, object] | None = None,
    found: str = "found",
) -> DataFrame:
    """Features of each request by key; absent ones take their default.

    ``found`` tells a stored zero from a missing key.
    """
    defaults = DEFAULTS if defaults is None else defaults
    stored = snapshot.select(*keys, *[c for c in defaults if c in snapshot.columns], F.lit(True).alias(found))
    joined = requests.join(stored, on=list(keys), how="left")
    return default_missing(joined, {**defaults, found: False})


def children_of(stops: DataFrame, child: str = "stop_id", parent: str = "parent_station") -> DataFrame:
    """(parent, child) rows; a null or empty id on either side is skipped.

    Rows rather than a list per parent: a list would hold a whole group.
    """
    return stops.select(F.col(parent).alias("parent"), F.col(child).alias("child")).filter(
        (F.coalesce("parent", F.lit("")) != "") & (F.coalesce("child", F.lit("")) != "")
    )


def child_order(child: Column) -> Column:
    """Sort key of a station's children: platforms first, then by id."""
    return F.struct(F.when(is_platform(child), 0).otherwise(1).alias("kind"), child.alias("id"))


def ranked_children(children: DataFrame, limit: int | None = None) -> DataFrame:
    """The children of each parent with their rank, or only the first ``limit``.

    Spark pushes the limit on the rank below the shuffle, so every task first
    keeps only its own first rows of a parent.
    """
    by_parent = Window.partitionBy("parent").orderBy(child_order(F.col("child")))
    ranked = children.withColumn("rank", F.row_number().over(by_parent))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def rollup_requests(
    requests: DataFrame,
    snapshot: DataFrame,
    children: DataFrame,
    *,
    features: Sequence[str] = FEATURES,
    prefix: str = "place-",
    max_combinations: int | None = None,
) -> DataFrame:
    """Features of station requests, rolled up from the stations' child stops.

    A request is answered if its origin or destination starts with ``prefix``
    and some pair of child stops has features. A stop that is no parent stands
    for itself. Numeric features are means over the stored pairs, nulls
    skipped, 0.0 if all are null; ``h3`` is the first known one in the order of
    the pairs.

    Work starts from the requests: their stations are put in place of their
    child stops, and only stored rows whose origin is such a stop (or a requested
    stop) go further. All pairs count; the original takes the first 500 of a
    request, in origin-major order, which ``max_combinations=500`` does. Then
    ``pairs_left_out`` says how many pairs of the request were not looked at.
    """
    keys = list(KEY)
    wanted = (
        requests.select(*keys)
        .filter(has_prefix(F.col("origin_stop"), prefix) | has_prefix(F.col("dest_stop"), prefix))
        .distinct()
    )
    ranked = children.withColumn("rank", F.lit(1)) if max_combinations is None else ranked_children(children)
    sizes = children.groupBy("parent").agg(F.count("*").alias("size"))

    def members(stop: str, child: str, rank: str, width: str) -> DataFrame:
        """The requested stops of one side with the stops that stand for them."""
        asked = wanted.select(F.col(stop).alias("parent")).distinct().join(ranked, on="parent", how="left")
        own = asked.join(sizes, on="parent", how="left")
        return own.select(
            F.col("parent").alias(stop),
            F.coalesce("child", "parent").alias(child),
            F.coalesce("rank", F.lit(1)).alias(rank),
            F.coalesce("size", F.lit(1)).alias(width),
        )

    origins = members("origin_stop", "__from", "__o", "__o_width")
    dests = members("dest_stop", "__to", "__d", "__d_width")
    stored = snapshot.select(
        F.col("origin_stop").alias("__from"), F.col("dest_stop").alias("__to"), "horizon_min", *features, "h3"
    )
    stored = stored.join(wanted.select("horizon_min").distinct(), on="horizon_min", how="left_semi")
    reached = stored.join(origins, on="__from", how="inner").join(dests, on="__to", how="inner")
    matched = reached.join(wanted, on=keys, how="inner")
    if max_combinations is not None:
        place = (F.col("__o") - 1) * F.col("__d_width") + F.col("__d")
        matched = matched.filter(place <= max_combinations)
    known_h3 = F.when(~F.coalesce(F.col("h3"), F.lit("")).isin("", UNKNOWN), F.col("h3"))
    order = F.when(known_h3.isNotNull(), F.struct(child_order(F.col("__from")), child_order(F.col("__to")), "h3"))
    answers = [
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in features],
        F.coalesce(F.min_by(known_h3, order), F.lit(UNKNOWN)).alias("h3"),
    ]
    if max_combinations is not None:
        pairs = F.first("__o_width") * F.first("__d_width")
        answers.append(F.greatest(pairs - max_combinations, F.lit(0)).cast("long").alias("pairs_left_out"))
    return matched.groupBy(*keys).agg(*answers)


def lookup_with_rollup(
    requests: DataFrame, snapshot: DataFrame, children: DataFrame, *, max_combinations: int | None = None
) -> DataFrame:
    """Direct look-up first, then the child rollup, then defaults.

    ``source`` says which answered: "direct", "children" or "default".
    """
    keys = list(KEY)
    names = list(DEFAULTS)
    direct = snapshot.select(*keys, F.struct(*names).alias("__direct"))
    asked = requests.join(direct, on=keys, how="left")
    missed = asked.filter(F.col("__direct").isNull()).select(*keys)
    rolled = rollup_requests(missed, snapshot, children, max_combinations=max_combinations)
    answered = asked.join(rolled.select(*keys, F.struct(*names).alias("__rolled")), on=keys, how="left")
    hit = F.coalesce("__direct", "__rolled")
    source = F.when(F.col("__direct").isNotNull(), "direct").when(F.col("__rolled").isNotNull(), "children").otherwise("default")
    return answered.select(
        *requests.columns,
        *[F.coalesce(hit.getField(n), F.lit(v)).alias(n) for n, v in DEFAULTS.items()],
        source.alias("source"),
    )
