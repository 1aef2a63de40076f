"""Connected components on the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.stored import forget, stored, stored_at


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges.

    Alternates two steps until nothing changes: every node hands the smallest of
    its neighbours and itself to its larger neighbours, then to its smaller
    ones. A hub's neighbours are never gathered: its minimum is pre-aggregated
    and the join that hands it out can be split. Each round is written to the
    shared folder. Edges with a null end are left out; loops and repeats are
    allowed, a node with a loop only is its own component.
    """
    given = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null"), "edges")
    links, path = stored_at(
        given.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    now, before = _state(links), None
    while now != before:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        new, new_path = stored_at(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        forget(links, path)
        links, path = new, new_path
        now, before = _state(links), now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    nodes = nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    loops = given.filter("a = b").select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(loops.join(nodes.select("node"), "node", "left_anti"))
