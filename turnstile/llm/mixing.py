"""Mix sources to target weights under a token budget.

Weights run down a tree of columns, such as domain, language, source. A node
shares its tokens among its children by weight; a child takes no more than its
subtree holds, and what it leaves goes to its siblings, and to the siblings of
an ancestor only when all of its own are full. Each leaf then takes whole seeded
epochs of its documents and, from the next epoch's order, a prefix of tokens
that ends inside a document if it must.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.stored import stored

WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def waterfill(nodes: DataFrame, parent: Sequence[str], key: str) -> DataFrame:
    """Adds ``given``: the share of ``amount`` that each child gets, in whole tokens.

    Rows have weight (a positive integer), held (its capacity) and amount (its
    parent's tokens, at most the sum of held). Children are walked from the
    fullest, by held over weight: one is capped if the weights left would give it
    more than it holds. The others share the rest by weight, rounded down; single
    tokens left over go to them in order of their key.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(_wide("held") / _wide("weight"), key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        nodes.withColumn("_used", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(after))
        .withColumn("_capped", (_wide("amount") - _wide("_used")) * _wide("weight") >= _wide("held") * _wide("_left"))
    )
    open_ = ~F.col("_capped")
    rows = (
        rows.withColumn("_rest", F.col("amount") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("held"))).over(by), F.lit(0)))
        .withColumn("_open", F.sum(F.when(open_, F.col("weight"))).over(by))
        .withColumn("_floor", F.when(open_, F.expr("CAST(_rest AS DECIMAL(20,0)) * CAST(weight AS DECIMAL(10,0)) DIV CAST(_open AS DECIMAL(20,0))")))
    )
    rows = rows.withColumn("_spare", F.col("_rest") - F.coalesce(F.sum("_floor").over(by), F.lit(0)))
    rank = F.sum(F.when(open_, 1).otherwise(0)).over(by.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    given = F.when(F.col("_capped"), F.col("held")).otherwise(F.col("_floor") + F.when(rank <= F.col("_spare"), 1).otherwise(0))
    return rows.withColumn("given", given.cast("long")).drop("_used", "_left", "_capped", "_rest", "_open", "_floor", "_spare")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: dict[str, dict[str, int]], budget: int | None, share: float, epochs: int
) -> DataFrame:
    """(levels, tokens, given) for each leaf of (levels, tokens).

    ``weights`` has an integer per value and level; values that are not listed
    weigh 1, values that weigh 0 get nothing and do not count as being there. The budget is ``budget`` or ``share``
    of all tokens, and never more than ``epochs`` times what there is.
    """
    shut = F.lit(False)
    for level in levels:
        closed = [value for value, weight in weights.get(level, {}).items() if weight == 0]
        shut = shut | F.col(level).isin(closed) if closed else shut
    leaves = leaves.withColumn("held", F.when(shut, 0).otherwise(F.col("tokens") * epochs).cast("long"))
    found = leaves.agg(
        F.coalesce(F.sum(F.when(~shut, F.col("tokens"))), F.lit(0)).alias("all"), F.coalesce(F.sum("held"), F.lit(0)).alias("most")
    ).first()
    amount = min(budget if budget is not None else math.floor(found["all"] * share), found["most"])
    above = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("held").alias("held"))
        table = weights.get(level, {})
        pairs = [F.lit(x) for value, weight in table.items() for x in (value, max(weight, 1))]
        weight = F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(1)) if pairs else F.lit(1)
        nodes = nodes.withColumn("weight", weight.cast("long"))
        nodes = nodes.join(above, path[:-1]) if above is not None else nodes.withColumn("amount", F.lit(amount).cast("long"))
        above = waterfill(nodes, path[:-1], level).select(*path, F.col("given").alias("amount"))
    return leaves.join(above, list(levels)).select(*levels, "tokens", F.col("amount").alias("given"))


def words_ahead(rows: DataFrame, path: Sequence[str], part: str) -> DataFrame:
    """(path, part, held_words, ahead): words of each part of a leaf and of the parts before it."""
    sums = rows.groupBy(*path, part).agg(F.sum("n_words").alias("held_words"))
    before = Window.partitionBy(*path).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("ahead", F.coalesce(F.sum("held_words").over(before), F.lit(0)))


def _cut_inside(rows: DataFrame, path: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``prefix_words`` to the rows of the ranges in which an epoch ends.

    They are partitioned by their order, and only the partition in which the epoch
    ends is sorted. The partition of a row is written down, since what follows
    reads it twice.
    """
    first = rows.withColumnRenamed("ahead", "range_ahead").drop("held_words")
    dealt = stored(first.repartitionByRange(*path, *order).withColumn("part", F.spark_partition_id()), "ends")
    dealt = dealt.join(words_ahead(dealt, path, "part"), [*path, "part"]).withColumn("ahead", F.col("range_ahead") + F.col("ahead"))
    cut = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("held_words") > F.col("rest"))
    inside = Window.partitionBy(*path, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("n_words").over(inside), F.lit(0))
    room = F.greatest(F.lit(0), F.least(F.col("n_words"), F.col("rest") - F.col("before")))
    ends = dealt.filter(cut).withColumn("before", before).withColumn("prefix_words", room).drop("before")
    whole = dealt.filter(~cut).withColumn("prefix_words", F.when(F.col("ahead") < F.col("rest"), F.col("n_words")).otherwise(F.lit(0)))
    return whole.unionByName(ends).drop("part", "range_ahead")


def mix(
    df: DataFrame,
    levels: Sequence[str],
    weights: dict[str, dict[str, int]],
    budget: int | None = None,
    share: float = 1.0,
    epochs: int = 1,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, levels, n_words, full_epochs, prefix_words, given, carry) for every row of ``df``.

    full_epochs: how often the whole document is taken; prefix_words: how many of
    its first words the last, partial epoch takes. The words taken in a leaf sum
    up to ``given``. A null level counts as the value ""; null and empty texts
    have no words and cost nothing. A weight is a whole number, else it is refused
    by name; a value of weight 0 gets nothing. Documents of an epoch are ordered by the md5
    of seed, epoch and id, then by that of the text, then by what is carried. Only
    (leaf, range) sums are sorted, and of the one range of an epoch's order in which
    it ends a part: the rows of all such ranges are dealt out by their order, also
    where they share an id, have none or are equal, so neither a hot leaf nor a hot
    id is gathered.
    """
    for level in levels:
        for value, weight in weights.get(level, {}).items():
            if not isinstance(weight, int) or weight < 0:
                raise ValueError(f"the weight of {level} {value!r} is not a whole number from 0: {weight!r}")
    others = [F.struct(*carry).alias("others")] if carry else []
    rows = stored(
        df.select(
            F.col(id).cast("long").alias("id"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"l{i}") for i, c in enumerate(levels)],
            tokens_of(F.col(text)).alias("n_words"),
            F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
            F.monotonically_increasing_id().alias("row"),
            *others,
        ),
        "lengths",
    )
    path = [f"l{i}" for i in range(len(levels))]
    tables = {f"l{i}": weights.get(c, {}) for i, c in enumerate(levels)}
    leaves = rows.groupBy(*path).agg(F.sum("n_words").alias("tokens"))
    plan = leaf_budgets(leaves, path, tables, budget, share, epochs)
    plan = plan.withColumn("full_epochs", F.when(F.col("tokens") > 0, F.expr("given DIV tokens")).otherwise(F.lit(0)))
    plan = stored(plan.withColumn("rest", F.col("given") - F.col("full_epochs") * F.col("tokens")), "plan")
    placed = rows.join(plan.drop("tokens"), path).withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    )
    placed = placed.withColumn("range", F.substring("place", 1, 3))
    placed = placed.join(words_ahead(placed, path, "range"), [*path, "range"])
    cut = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("held_words") > F.col("rest"))
    ends = _cut_inside(placed.filter(cut), path, ["place", "id", "tie", *(["others"] if carry else []), "row"])
    whole = placed.filter(~cut).withColumn("prefix_words", F.when(F.col("ahead") < F.col("rest"), F.col("n_words")).otherwise(F.lit(0)))
    names = [F.col(f"l{i}").alias(c) for i, c in enumerate(levels)]
    return whole.unionByName(ends).select(
        F.col("id").alias(id), *names, "n_words", F.col("full_epochs").cast("long"), F.col("prefix_words").cast("long"), "given",
        *(["others.*"] if carry else []),
    )
