"""Boosted quantile trees.

Features are cut into bins at exact quantiles, once, and the rows are kept in blocks:
rows with equal bins lie side by side as one cell, since a tree cannot tell them
apart, with their labels in order. So trees are followed once per cell and a pass
reads few, large rows. Each round grows one tree to the gradient of the pinball loss,
level by level: every task adds up counts and gradients per (node, feature, bin) of its
cells, Spark adds these up, and the driver gets the sums, whose number the settings
bound, and picks the splits. The leaves take the exact quantile of their residuals. All sums are of integers and
rows are sampled by a hash of their values, so a model depends on the rows alone,
not on how they are spread. The running prediction is checkpointed every few
rounds.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.values import number_or_zero
from turnstile.operators.gold import exact_group_quantiles
from turnstile.session import remove_work, shared_folder, work_path

# Gradients and losses are added up as integers of these units.
UNIT = 10_000
LOSS_UNIT = 10**9
HALF = 2**32
# A row takes part in a round if its share is below ``row_fraction`` of these.
SHARES = 1_000_000
# Rows of a block: its cells are worked on at once.
BLOCK = 2**18


@dataclass(frozen=True)
class BoostingParams:
    rounds: int = 200
    learning_rate: float = 0.1
    leaves: int = 31
    min_rows: int = 20
    bins: int = 64
    feature_fraction: float = 1.0
    row_fraction: float = 1.0
    early_stopping: int = 20
    checkpoint_every: int = 10
    seed: int = 7

    @property
    def depth(self) -> int:
        return max(1, math.ceil(math.log2(max(self.leaves, 2))))


@dataclass
class Tree:
    """Nodes as parallel lists; node 0 is the root and a leaf has feature -1. Bins up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    @property
    def splits(self) -> int:
        return sum(f >= 0 for f in self.feature)

    def split(self, node: int, feature: int, bin: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = feature, bin, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [empty, empty]
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of binned features."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        rows = np.flatnonzero(feature[node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at])
            rows = rows[feature[node[rows]] >= 0]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class QuantileModel:
    quantile: float
    features: list[str]
    base: float
    learning_rate: float
    bounds: list[list[float]] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, output: str) -> DataFrame:
        """Add the quantile as ``output`` in one vectorised pass over all trees; missing features count as 0."""
        model = self

        @F.pandas_udf("double")
        def quantile(*columns: pd.Series) -> pd.Series:
            bins = binned(np.column_stack([c.to_numpy(np.float64) for c in columns]), model.bounds)
            total = np.full(len(bins), model.base)
            for tree in model.trees:
                total += model.learning_rate * tree.values(bins)
            return pd.Series(total)

        kept = [c for c in df.columns if c != output]
        if not self.trees:
            return df.select(*kept, F.lit(float(self.base)).alias(output))
        return df.select(*kept, quantile(*[_number(df, c) for c in self.features]).alias(output))

    def mean_importance(self) -> float:
        """Splits per feature, averaged over the features."""
        return sum(t.splits for t in self.trees) / len(self.features)

    def feature_importance(self) -> dict[str, float]:
        """Each feature's share of its tree's gains, summed over all trees."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            gains = sum(tree.gain) or 1.0
            for feature, gain in zip(tree.feature, tree.gain, strict=True):
                if feature >= 0:
                    total[self.features[feature]] += gain / gains
        return total

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileModel:
        head = json.loads(spark.read.text(path).first()[0])
        return cls(trees=[Tree(**t) for t in head.pop("trees")], **head)


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    return F.nanvl(number_or_zero(F.col(name)), F.lit(0.0)).cast("double")


def binned(values: np.ndarray, bounds: Sequence[Sequence[float]]) -> np.ndarray:
    """The bin of each value: how many bounds of its feature are below it."""
    return np.column_stack([np.searchsorted(np.asarray(b, np.float64), values[:, i]) for i, b in enumerate(bounds)])


def _names(n: int) -> list[str]:
    return [f"__f{i}" for i in range(n)]


def bin_bounds(rows: DataFrame, n: int, bins: int) -> list[list[float]]:
    """Distinct exact quantiles of each feature, without the largest value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("x")) for i, c in enumerate(_names(n))]))
    long = rows.select(pairs.alias("p")).select("p.f", "p.x")
    probs = {f"q{i}": i / bins for i in range(1, bins + 1)}
    found = {r.f: r for r in exact_group_quantiles(long, ["f"], "x", probs).collect()}
    return [sorted({found[i][q] for q in probs})[:-1] if i in found else [] for i in range(n)]


def _bin_type(bounds: Sequence[Sequence[float]]) -> type:
    return np.uint8 if max(map(len, bounds), default=0) < 256 else np.uint16


def _codes(bins: np.ndarray) -> np.ndarray:
    """One number per row of bins, equal where all bins are equal."""
    code, size = np.zeros(len(bins), np.int64), 1
    for column in bins.T.astype(np.int64):
        width = int(column.max(initial=0)) + 1
        if size * width >= 2**62:
            known, code = np.unique(code, return_inverse=True)
            size = len(known)
        code, size = code * width + column, size * width
    return code


def _packed(rows: DataFrame, n: int, bounds) -> DataFrame:
    """The training rows in blocks: cells of rows with equal bins, their labels ascending, and their hashes if given."""
    kind = _bin_type(bounds)
    hashed = ["__row"] if "__row" in rows.columns else []
    fields = ["__bins binary", "__counts binary", "__y binary", "__train boolean", *["__rows array<bigint>" for _ in hashed]]
    names = [f.split()[0] for f in fields]

    def block(parts: list[tuple[np.ndarray, ...]], is_train: bool) -> pa.RecordBatch:
        bins, label, *row = (np.concatenate(x) for x in zip(*parts, strict=True))
        code = _codes(bins)
        order = np.lexsort((label, code))
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        counts = np.diff(np.r_[first, len(code)])
        cells = [bins[order[first]].tobytes(), counts.astype(np.int64).tobytes(), label[order].tobytes()]
        hashes = [pa.array([r[order]], pa.list_(pa.int64())) for r in row]
        return pa.record_batch([*[pa.array([c], pa.binary()) for c in cells], pa.array([is_train]), *hashes], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _names(n)])
            columns = binned(values, bounds).astype(kind), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("__y", *hashed))
            learns = batch.column("__train").to_numpy(zero_copy_only=False)
            for is_train, parts in waiting.items():
                own = learns == is_train
                if own.any():
                    parts.append(tuple(c[own] for c in columns))
                if sum(len(p[1]) for p in parts) >= BLOCK:
                    yield block(parts, is_train)
                    parts.clear()
        for is_train, parts in waiting.items():
            if parts:
                yield block(parts, is_train)

    return rows.mapInArrow(pack, ", ".join(fields))


@dataclass
class Block:
    """Cells of rows with equal bins; labels lie cell after cell and ascend in each. A prediction is a cell's."""

    bins: np.ndarray
    counts: np.ndarray
    y: np.ndarray
    preds: np.ndarray
    share: np.ndarray | None

    def prediction(self, trees: Sequence[Tree], rate: float, slot: int = 0) -> np.ndarray:
        total = self.preds[:, slot].copy()
        for tree in trees:
            total += rate * tree.values(self.bins)
        return total

    def errors(self, prediction: np.ndarray) -> np.ndarray:
        return self.y - np.repeat(prediction, self.counts)

    def per_cell(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows marked each cell has."""
        return np.add.reduceat(rows, np.cumsum(self.counts) - self.counts, dtype=np.int64)

    def gradients(self, prediction: np.ndarray, up: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and gradient sum of each cell, of the rows whose share is below the limit."""
        above, seen = self.y > np.repeat(prediction, self.counts), self.counts
        if limit < SHARES:
            picked = self.share < limit
            above, seen = above & picked, self.per_cell(picked)
        return seen, up * seen - UNIT * (seen - self.per_cell(above))

    def add_level(self, own: np.ndarray, seen: np.ndarray, gradient: np.ndarray, width: int, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add the cells of the level's nodes to its sums per (node, feature, bin)."""
        some = own >= 0
        bins, own, seen, gradient = self.bins[some], own[some], seen[some], gradient[some]
        for f in range(bins.shape[1]):
            at = (own * bins.shape[1] + f) * width + bins[:, f]
            counts += np.bincount(at, seen, minlength=len(counts))
            sums += np.bincount(at, gradient, minlength=len(sums))

    def digit_runs(self, prediction: np.ndarray, leaf: np.ndarray, shift: int, known: np.ndarray | None) -> list[np.ndarray]:
        """(leaf and digit, rows, least key, largest key) of runs of residuals with one digit.

        In a cell the residuals ascend, so equal digits lie side by side. ``known``
        has the digits of each leaf so far, -1 for leaves that are done.
        """
        cell = np.repeat(np.arange(len(leaf)), self.counts)
        if known is None:
            key = sortable(self.y - prediction[cell])
        else:
            asked = known[leaf][cell] >= 0
            cell = cell[asked]
            key = sortable(self.y[asked] - prediction[cell])
        high = (key.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(shift)
        if known is not None:
            own = (high >> np.uint64(DIGIT)).astype(np.int64) == known[leaf][cell]
            cell, key, high = cell[own], key[own], high[own]
        new = (high[1:] != high[:-1]) | (cell[1:] != cell[:-1])
        first = np.flatnonzero(np.r_[True, new][: len(key)])
        last = np.r_[first[1:], len(key)][: len(first)] - 1
        digit = (high[first] & np.uint64(2**DIGIT - 1)).astype(np.int64)
        return [leaf[cell[first]].astype(np.int64) << DIGIT | digit, last - first + 1, key[first], key[last]]

    def loss(self, prediction: np.ndarray, quantile: float) -> tuple[int, int, int]:
        """The pinball losses in units, as multiples of HALF and the rest, and the rows."""
        error = self.errors(prediction)
        units = np.floor(np.maximum(quantile * error, (quantile - 1.0) * error) * LOSS_UNIT + 0.5)
        upper = np.floor(units / HALF)
        return int(upper.sum()), int((units - upper * HALF).sum()), len(error)


def blocks(batch: pa.RecordBatch, n: int, kind: type, slots: int = 1) -> Iterator[Block]:
    """The blocks of a batch of the training state; ``__pred`` is one number until trees have been added."""

    def read(name: str, i: int, kind: type) -> np.ndarray:
        return np.frombuffer(batch.column(name)[i].as_buffer(), kind)

    shares = batch.column("__share") if "__share" in batch.schema.names else None
    same = pa.types.is_floating(batch.column("__pred").type)
    for i in range(len(batch)):
        counts = read("__counts", i, np.int64)
        preds = np.full((len(counts), slots), batch.column("__pred")[i].as_py()) if same else read("__pred", i, np.float64).reshape(-1, slots)
        share = None if shares is None else shares[i].values.to_numpy(zero_copy_only=False)
        yield Block(read("__bins", i, kind).reshape(-1, n), counts, read("__y", i, np.float64), preds, share)


def merged(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Runs of all blocks, those of one leaf and digit added up."""
    code, rows, low, high = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(code, kind="stable")
    code, rows, low, high = code[order], rows[order], low[order], high[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    if not len(first):
        return [code, rows, low, high]
    return [code[first], np.add.reduceat(rows, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)]


def shared(state: DataFrame, seed: int) -> DataFrame:
    """The state with each row's share for a round's sample: a number below SHARES that its values give."""
    return state.withColumn("__share", F.transform("__rows", lambda row: F.pmod(F.xxhash64(F.lit(seed), row), F.lit(SHARES))))


def with_predictions(state: DataFrame, predictions: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """The state with new predictions of all cells, checkpointed."""
    kept = state.drop("__pred")
    names = kept.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array([np.ascontiguousarray(p).tobytes() for p in predictions(batch)], pa.binary())
            yield pa.record_batch([*[batch.column(c) for c in names], cells], [*names, "__pred"])

    return state.mapInArrow(add, T.StructType([*kept.schema.fields, T.StructField("__pred", T.BinaryType())])).checkpoint()


def _level_sums(sample: DataFrame, n: int, bounds, done: Sequence[Tree], rate: float, tree: Tree, nodes: list[int], width: int, up: int, limit: int):
    """Counts and gradient sums per (node, feature, bin) of one level."""
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    size, kind = len(nodes) * n * width, _bin_type(bounds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(size), np.zeros(size)
        for batch in batches:
            for block in blocks(batch, n, kind):
                block.add_level(slot[tree.leaves(block.bins)], *block.gradients(block.prediction(done, rate), up, limit), width, counts, sums)
        some = np.flatnonzero(counts)
        yield pa.record_batch([some, counts[some].astype(np.int64), sums[some].astype(np.int64)], ["at", "n", "g"])

    rows = sample.drop("__rows").mapInArrow(add, "at bigint, n bigint, g bigint").groupBy("at").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    counts, sums = np.zeros(size), np.zeros(size)
    found = rows.toArrow()
    counts[found["at"]], sums[found["at"]] = found["n"], found["g"]
    return counts.reshape(len(nodes), n, width), sums.reshape(len(nodes), n, width)


def _best_split(counts: np.ndarray, sums: np.ndarray, features: Sequence[int], least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a node from its sums per feature and bin; of equal gains the first."""
    best = None
    for f in features:
        n, g = np.cumsum(counts[f]), np.cumsum(sums[f])
        left, right = n[:-1], n[-1] - n[:-1]
        allowed = (left >= max(least, 1)) & (right >= max(least, 1))
        if not allowed.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g[:-1] ** 2 / left + (g[-1] - g[:-1]) ** 2 / right - g[-1] ** 2 / n[-1]
        gain = np.where(allowed, gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > 0 and (best is None or gain[at] > best[0]):
            best = float(gain[at]), f, at
    return best


def sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def unsorted(keys: np.ndarray) -> np.ndarray:
    """The doubles of ``sortable``."""
    return (keys ^ ((keys >> 63) & np.int64(2**63 - 1))).view(np.float64)


#: Bits that one pass of the selection settles.
DIGIT = 16


def _leaf_quantiles(state: DataFrame, n: int, bounds, done: Sequence[Tree], rate: float, tree: Tree, quantile: float) -> dict[int, float]:
    """The exact discrete quantile of each leaf's residuals, without moving the rows.

    A pass counts the residuals of each leaf by their next ``DIGIT`` bits; running
    counts name the digit that holds the quantile, and the next pass looks at the
    residuals with this prefix only. It ends when they are all equal, after four passes
    at most. At most 2 ** DIGIT counts a leaf are shuffled; the driver gets one row per leaf.
    """
    prefix, rank, found, kind = {}, {}, {}, _bin_type(bounds)
    for step in range(64 // DIGIT):
        shift = 64 - DIGIT * (step + 1)
        wanted = dict(prefix)

        def count(batches: Iterator[pa.RecordBatch], shift=shift, wanted=wanted, step=step) -> Iterator[pa.RecordBatch]:
            known = np.full(len(tree.feature), -1, np.int64)
            for leaf, value in wanted.items():
                known[leaf] = value
            runs = []
            for batch in batches:
                for block in blocks(batch, n, kind):
                    runs.append(block.digit_runs(block.prediction(done, rate), tree.leaves(block.bins), shift, known if step else None))
                    runs = [merged(runs)]
            for code, rows, low, high in runs:
                yield pa.record_batch([code >> DIGIT, code & (2**DIGIT - 1), rows, low, high], ["leaf", "digit", "n", "low", "high"])

        sums = (
            state.drop("__rows").mapInArrow(count, "leaf bigint, digit bigint, n bigint, low bigint, high bigint")
            .groupBy("leaf", "digit")
            .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        )
        each = Window.partitionBy("leaf")
        upto = F.sum("n").over(each.orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        due = F.ceil(F.sum("n").over(each) * F.lit(float(quantile)))
        if step:
            due = F.element_at(F.create_map(*[F.lit(x) for item in rank.items() for x in item]), F.col("leaf"))
        picked = sums.withColumn("upto", upto).withColumn("due", F.greatest(due.cast("long"), F.lit(1))).filter("upto >= due")
        picked = picked.groupBy("leaf").agg(F.min(F.struct("digit", "n", "low", "high", "upto", "due")).alias("p")).select("leaf", "p.*")
        prefix_now, rank_now = {}, {}
        for r in picked.collect():
            if r.low == r.high:
                found[r.leaf] = float(unsorted(np.array([r.low], np.int64))[0])
            else:
                prefix_now[r.leaf] = (prefix.get(r.leaf, 0) << DIGIT) | r.digit
                rank_now[r.leaf] = r.due - (r.upto - r.n)
        prefix, rank = prefix_now, rank_now
        if not prefix:
            break
    return found


def _loss(state: DataFrame, n: int, bounds, done: Sequence[Tree], rate: float, quantile: float) -> float | None:
    """Mean pinball loss of the validation rows; None if there are none."""
    kind = _bin_type(bounds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block.loss(block.prediction(done, rate), quantile) for block in blocks(batch, n, kind)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in np.reshape(found, (-1, 3)).T.astype(np.int64)], ["upper", "lower", "n"])

    left = state.filter("not __train").drop("__rows").mapInArrow(add, "upper bigint, lower bigint, n bigint")
    wide = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    total = left.agg(wide("upper"), wide("lower"), F.sum("n").alias("n")).first()
    return float(int(total.upper) * HALF + int(total.lower)) / LOSS_UNIT / total.n if total.n else None


def _advanced(state: DataFrame, n: int, bounds, trees: Sequence[Tree], rate: float) -> DataFrame:
    """The state with the trees' values added to its predictions."""
    kind, trees = _bin_type(bounds), list(trees)
    return with_predictions(state, lambda batch: (block.prediction(trees, rate) for block in blocks(batch, n, kind)))


def prepare(
    train: DataFrame,
    valid: DataFrame | None,
    features: Sequence[str],
    label: str,
    quantiles: Sequence[float],
    params: BoostingParams,
    sampled: bool = True,
) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Packed training and validation rows, the constant each quantile starts from and the bounds of the bins.

    Only rows that rounds will sample from need their hashes.
    """
    shared_folder(train.sparkSession)
    n = len(features)

    def numbers(df: DataFrame, is_train: bool) -> DataFrame:
        target = F.col(label).cast("double").alias("__y")
        return df.select(*[_number(df, c).alias(f) for f, c in zip(_names(n), features, strict=True)], target, F.lit(is_train).alias("__train"))

    rows = numbers(train, True)
    if valid is not None:
        rows = rows.unionByName(numbers(valid, False))
    rows = rows.filter(F.col("__y").isNotNull() & ~F.isnan("__y"))
    if sampled:
        rows = rows.withColumn("__row", F.xxhash64(*_names(n), "__y"))
    path = work_path(train.sparkSession, "rows")
    rows.write.parquet(path)
    rows = train.sparkSession.read.schema(rows.schema).parquet(path)
    learn = rows.filter("__train")
    probs = {f"q{i}": q for i, q in enumerate(quantiles)}
    base = exact_group_quantiles(learn.select(F.lit(0).alias("g"), "__y"), ["g"], "__y", probs).collect()
    if not base:
        raise ValueError("no labelled training rows")
    bounds = bin_bounds(learn, n, params.bins) if params.rounds else [[] for _ in features]
    if params.rounds:
        rows = _packed(rows, n, bounds).checkpoint()
        remove_work(train.sparkSession, path)
    return rows, [float(base[0][name]) for name in probs], bounds


def fit_quantile(
    train: DataFrame,
    valid: DataFrame | None,
    features: Sequence[str],
    label: str,
    quantile: float,
    params: BoostingParams = BoostingParams(),
) -> QuantileModel:
    """Fit one quantile; stop early when the validation loss stops falling."""
    return fit_quantiles(train, valid, features, label, [quantile], params)[0]


def fit_quantiles(
    train: DataFrame,
    valid: DataFrame | None,
    features: Sequence[str],
    label: str,
    quantiles: Sequence[float],
    params: BoostingParams = BoostingParams(),
) -> list[QuantileModel]:
    """The models that ``fit_quantile`` gives for each quantile; the rows are binned and packed once for all."""
    if not quantiles:
        return []
    sampled = round(params.row_fraction * SHARES) < SHARES
    rows, bases, bounds = prepare(train, valid, features, label, quantiles, params, sampled)
    models = [QuantileModel(float(q), list(features), base, params.learning_rate, bounds) for q, base in zip(quantiles, bases, strict=True)]
    return [_grown(rows, model, params, valid is not None) for model in models]


def _grown(rows: DataFrame, model: QuantileModel, params: BoostingParams, checked: bool) -> QuantileModel:
    """The model with its trees, grown on packed rows; ``checked`` against the validation rows."""
    n, bounds, quantile = len(model.features), model.bounds, model.quantile
    state = rows.withColumn("__pred", F.lit(model.base))
    done: list[Tree] = []
    draw = random.Random(params.seed)
    width, up = max(map(len, bounds), default=0) + 1, round(quantile * UNIT)
    best, best_rounds = math.inf, 0
    for step in range(params.rounds):
        chosen = sorted(draw.sample(range(n), max(1, round(n * params.feature_fraction))))
        learn = state.filter("__train")
        limit = round(params.row_fraction * SHARES)
        sample = shared(learn, params.seed + step) if limit < SHARES else learn
        tree, nodes, n_leaves = Tree(), [0], 1
        for _ in range(params.depth):
            counts, sums = _level_sums(sample, n, bounds, done, params.learning_rate, tree, nodes, width, up, limit)
            found = [(_best_split(counts[i], sums[i], chosen, params.min_rows), node) for i, node in enumerate(nodes)]
            found = sorted(((s, node) for s, node in found if s), key=lambda x: (-x[0][0], x[1]))[: params.leaves - n_leaves]
            nodes = []
            for (gain, feature, bin), node in sorted(found, key=lambda x: x[1]):
                nodes += tree.split(node, feature, bin, gain)
            n_leaves += len(found)
            if not nodes:
                break
        for leaf, value in _leaf_quantiles(learn, n, bounds, done, params.learning_rate, tree, quantile).items():
            tree.value[leaf] = value
        model.trees.append(tree)
        done.append(tree)
        if (step + 1) % params.checkpoint_every == 0:
            state = _advanced(state, n, bounds, done, params.learning_rate)
            done = []
        best_rounds = best_rounds if checked else step + 1
        if not checked:
            continue
        loss = _loss(state, n, bounds, done, params.learning_rate, quantile)
        if loss is None:
            best_rounds = step + 1
            continue
        model.losses.append(loss)
        if loss < best:
            best, best_rounds = loss, step + 1
        elif step + 1 - best_rounds >= params.early_stopping:
            break
    model.trees = model.trees[:best_rounds]
    return model


def candidates(trials: int, start: BoostingParams) -> list[BoostingParams]:
    """Seeded draws from five ranges."""
    draw = random.Random(start.seed)
    # The ranges of the search.
    return [
        replace(
            start,
            learning_rate=math.exp(draw.uniform(math.log(0.01), math.log(0.3))),
            leaves=draw.randint(16, 128),
            feature_fraction=draw.uniform(0.5, 1.0),
            row_fraction=draw.uniform(0.5, 1.0),
            min_rows=draw.randint(10, 200),
        )
        for _ in range(trials)
    ]


def search_params(
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    label: str,
    quantile: float,
    trials: int,
    start: BoostingParams = BoostingParams(),
) -> BoostingParams:
    """Seeded random search over five ranges, by validation pinball loss; every trial is grown to its end."""
    best, best_loss = start, math.inf
    for candidate in candidates(trials, start):
        model = fit_quantile(train, valid, features, label, quantile, candidate)
        loss = min(model.losses, default=math.inf)
        if loss < best_loss:
            best, best_loss = candidate, loss
    return best


def score(df: DataFrame, models: dict[str, QuantileModel]) -> DataFrame:
    """Add one column per model."""
    for output, model in models.items():
        df = model.predict(df, output)
    return df
