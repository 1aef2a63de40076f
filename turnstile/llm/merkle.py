"""Merkle manifest of a dataset, with an inclusion proof for every row.

The rows of a tree (here: of a source) are its leaves in ascending order; every
run of ``FANOUT`` consecutive nodes becomes a node of the next level, and the
roots of all trees are in turn the leaves of one tree above them. Proofs are made
by pointer jumping: a node holds an ancestor and the siblings met on the way to
it; a self-join with the ancestor's own row doubles the distance and joins the
two segments, so the number of rounds is the logarithm of the height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.llm.order import partitions
from turnstile.llm.stored import forget, stored, stored_at

FANOUT = 3
#: The tree above all others; theirs are numbered from 0.
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields one after another."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """Digests one after another as hex text."""
    return F.array_join(F.transform(digests, _hex), "")


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with ``idx``, their place from 0 in ``order`` within their tree, and ``n``, the number of rows of it.

    Rows are parted and sorted by ranges of tree and order, so a tree of very many
    rows lies in many partitions; a row's place is its place in the partition plus
    the sizes of the partitions before it. Rows that are equal in all order columns
    follow each other in any order.
    """
    keys = [F.col(tree), *map(F.col, order)]
    spread = df.withColumn("copy", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(partitions(df), *keys, "copy").sortWithinPartitions(*keys, "copy").drop("copy")
    rows = stored(spread.withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(tree, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    ahead = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    sizes = sizes.withColumn("n", F.sum("size").over(Window.partitionBy(tree)))
    rows = rows.withColumn("part", part).join(sizes, [tree, "part"])
    return rows.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "size", "before")


def _levels(leaves: DataFrame, carry: list[str]) -> list[DataFrame]:
    """For each level above the leaves a stored table (tree, n, level, parent, kids) of its runs.

    A tree with n leaves has a node more than one at a level as long as n is above
    FANOUT ** level. ``carry`` columns of the leaves travel with the kids of the first level.
    """
    nodes, level, tables = leaves, 0, []
    while True:
        kid = F.struct("idx", "digest", *(carry if level == 0 else []))
        runs = (
            nodes.filter(F.col("n") > FANOUT**level)
            .groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("parent"))
            .agg(F.array_sort(F.collect_list(kid)).alias("kids"))
            .withColumn("level", F.lit(level))
        )
        runs = stored(runs, "runs")
        if runs.isEmpty():
            return tables
        tables.append(runs)
        nodes, level = _parents(runs), level + 1


def _parents(runs: DataFrame) -> DataFrame:
    return runs.select(
        "tree", "n", F.col("parent").alias("idx"), F.unhex(F.sha2(_joined(F.col("kids.digest")), 256)).alias("digest")
    )


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's root; the only leaf of a tree is its root."""
    found = leaves.filter("n = 1").select("tree", "digest")
    for k, runs in enumerate(levels, 1):
        found = found.unionByName(_parents(runs.filter(F.col("n") <= FANOUT**k)).select("tree", "digest"))
    return found


def _steps(runs: DataFrame, carry: list[str]) -> DataFrame:
    """One row per node below the roots: its parent, and its siblings before and after it."""
    rows = runs.select("tree", "n", "level", "parent", F.posexplode("kids").alias("place", "kid"), "kids")
    digests = F.col("kids.digest")
    empty = F.lit(b"")
    cut = lambda xs: F.array_join(F.transform(xs, F.hex), "")
    before = F.coalesce(F.unhex(cut(F.slice(digests, F.lit(1), F.col("place")))), empty)
    after = F.coalesce(F.unhex(cut(F.slice(digests, F.col("place") + 2, F.lit(FANOUT)))), empty)
    return rows.select(
        "tree", "n", "level", F.col("kid.idx").alias("idx"), F.col("kid.digest").alias("digest"), F.col("parent").alias("up"),
        F.array(F.struct(before.alias("before"), after.alias("after"))).alias("path"),
        *(F.col(f"kid.{c}").alias(c) for c in carry),
    )


def height(n: Column) -> Column:
    """Levels above the leaves of a tree with n leaves."""
    powers = F.array(*(F.lit(FANOUT**k) for k in range(40) if FANOUT**k < 2**62))
    return F.size(F.filter(powers, lambda p: p < n))


def _jump(nodes: DataFrame, top: int) -> DataFrame:
    """Pointer jumping until every leaf holds its way to the root, level ``top`` of the tree above.

    After round r a node holds its ancestor at distance 2 ** r, so the next round
    needs the rows of nodes at that level or above alone: the joined side is a small
    share of the leaves and shrinks with each round.
    """
    nodes, path = stored_at(nodes, "pointers")
    span = 1
    done = (F.col("up_tree") == TOP) & (F.col("up_level") == top)
    while not nodes.filter(~done).isEmpty():
        high = nodes.filter((F.col("level") >= span) | (F.col("tree") == TOP) | F.col("is_root"))
        high = high.select(
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up"),
            F.col("up_tree").alias("next_tree"), F.col("up_level").alias("next_level"), F.col("up").alias("next"),
            F.col("path").alias("further"),
        )
        moved = nodes.filter(~done).join(high, ["up_tree", "up_level", "up"])
        moved = moved.withColumns(
            {"up_tree": F.col("next_tree"), "up_level": F.col("next_level"), "up": F.col("next"), "path": F.concat("path", "further")}
        ).select(nodes.columns)
        span *= 2
        needed = (F.col("level") == 0) | (F.col("level") >= span) | (F.col("tree") == TOP) | F.col("is_root")
        new, new_path = stored_at(nodes.filter(done).unionByName(moved).filter(needed), "pointers")
        forget(nodes, path)
        nodes, path = new, new_path
    return nodes


def proofs(leaves: DataFrame, tree: str, order: str, leaf: str, carry: list[str]) -> DataFrame:
    """(tree, leaf, carry..., subroot, root, path) for each row of ``leaves``.

    ``leaf`` is the row's digest as hex, ``order`` its place among the rows of its
    tree (null first, then ties by digest), ``path`` the siblings before and after
    each node on the way to the root, from the leaf on, as binary digests. Null is a
    tree of its own and comes first; the others follow by the bytes of their names.
    Repeated rows are leaves each. An empty table gives no rows. ``carry`` may not
    name tree, leaf, subroot, root or path.
    """
    name = F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit(""))
    rows = leaves.select(
        name.alias("name"), F.col(order).alias("order"), F.unhex(leaf).alias("digest"), F.struct(*carry, F.col(tree).alias("tree")).alias("row")
    )
    rows = numbered(rows, "name", ["order", "digest"])
    names = rows.filter("idx = 0").select("name", F.lit(0).alias("all"), F.col("n").alias("leaves"))
    names = numbered(names, "all", ["name"]).select("name", F.col("idx").alias("tree"), "leaves", F.col("n").alias("trees"))
    names = stored(names, "trees")
    count = names.count()
    if not count:
        empty = leaves.select(F.col(tree).alias("tree"), F.col(leaf).alias("leaf"), *carry)
        return empty.withColumns({"subroot": F.lit(""), "root": F.lit(""), "path": F.expr("array(named_struct('before', X'', 'after', X''))")})
    base = rows.join(names.select("name", "tree"), "name").select("tree", "n", "idx", "digest", "row")
    base = stored(base, "leaves")
    levels = _levels(base, ["row"])
    subroots = stored(_roots(base, levels), "subroots")
    uppers = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"
    )
    above = _levels(uppers, [])
    root = _hex(F.lit(_roots(uppers, above).first().digest))

    single = base.filter("n = 1").select("tree", "n", F.lit(0).alias("level"), "idx", "digest", "row")
    steps = None
    for k, runs in enumerate(levels):
        part = _steps(runs, ["row"] if k == 0 else [])
        part = part if k == 0 else part.withColumn("row", F.lit(None).cast(base.schema["row"].dataType))
        end = (F.col("n") <= FANOUT ** (k + 1)) & F.lit(len(above) == 0)
        part = part.withColumns({"up_tree": F.when(end, F.lit(TOP)).otherwise(F.col("tree")).cast("long"), "up_level": F.when(end, F.lit(0)).otherwise(F.lit(k + 1))})
        steps = part if steps is None else steps.unionByName(part)
    # A tree's root is a leaf of the tree above: its row takes that leaf's way up.
    sizes = names.select("tree", F.col("leaves").alias("n"))
    lifted = None
    for k, runs in enumerate(above):
        part = _steps(runs, []).withColumns({"up_tree": F.lit(TOP).cast("long"), "up_level": F.lit(k + 1)}).drop("n")
        if k == 0:
            part = part.drop("tree", "level").withColumnRenamed("idx", "tree").join(sizes, "tree")
            part = part.withColumns({"level": height(F.col("n")), "idx": F.lit(0).cast("long")})
        else:
            part = part.withColumn("n", F.lit(None).cast("long"))
        lifted = part if lifted is None else lifted.unionByName(part)
    kind = base.schema["row"].dataType
    no_row = F.lit(None).cast(kind)
    nodes = steps.withColumn("is_root", F.lit(False)) if steps is not None else None
    if lifted is not None:
        # the only leaf of a tree is its root as well: it keeps its row
        own = single.select("tree", F.lit(0).alias("level"), "row")
        lifted = lifted.join(own, ["tree", "level"], "left") if not own.isEmpty() else lifted.withColumn("row", no_row)
        lifted = lifted.withColumn("is_root", F.col("tree") != TOP)
        nodes = lifted if nodes is None else nodes.unionByName(lifted)
    columns = ["tree", "level", "idx", "digest", "row", "up_tree", "up_level", "up", "path", "is_root"]
    if nodes is None:  # one leaf in all
        ends = single.select("tree", "digest", "row", F.expr("filter(array(named_struct('before', X'', 'after', X'')), x -> false)").alias("path"))
    else:
        ends = _jump(nodes.select(columns), len(above)).filter("level = 0 and row is not null").select("tree", "digest", "row", "path")
    subroots = subroots.select("tree", _hex(F.col("digest")).alias("subroot"))
    found = ends.join(subroots, "tree").select(
        F.col("row.tree").alias("tree"), _hex(F.col("digest")).alias("leaf"), *(F.col(f"row.{c}").alias(c) for c in carry), "subroot", root.alias("root"), "path"
    )
    return found


def siblings_digest(path: Column) -> Column:
    """Hex sha256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(_hex(x["before"]), _hex(x["after"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to, as hex."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(_hex(x["before"]), acc, _hex(x["after"])), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", tree: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the ``fields``; the leaves of a tree ascend by id. Rows
    whose id has an even crc32 (of its decimal form; a null id counts as odd) are
    tampered with: their text loses its newlines, and ``folded_root`` is what this
    leaf and the original siblings lead to. A null text stays null; an empty one, or
    one without newlines, is not changed by it. Other columns of ``df`` are not read.
    """
    whole = digest(*(F.col(c) for c in fields))
    cut = digest(*(F.translate(c, "\n", "") if c == text else F.col(c) for c in fields))
    even = F.coalesce(F.crc32(F.col(id).cast("string")) % 2 == 0, F.lit(False))
    changed = even & F.coalesce(F.instr(F.col(text), "\n") > 0, F.lit(False))
    leaves = df.select(
        F.col(id).alias("id"), F.col(tree).alias("tree"), whole.alias("leaf"), F.when(changed, F.unhex(cut)).alias("changed")
    )
    found = proofs(leaves, "tree", "id", "leaf", ["id", "changed"])
    folded = fold(F.coalesce(_hex(F.col("changed")), F.col("leaf")), F.col("path"))
    found = found.select(F.col("id").alias(id), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
