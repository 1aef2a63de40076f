"""Search for boosting parameters by successive halving (M3).

All live trials grow one round in the same passes over the rows: the trial is a key of
the level sums, of the digit counts that give the leaves' quantiles, and of the
validation losses. Rows are binned and packed once for all trials. At each rung the
worse half is dropped by the least validation loss so far and the rest grows on; the last one
grows to its end, so the search returns its model as well. Each trial's trees and
losses are those that ``fit_quantile`` gives for its parameters alone.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.operators.boosting import (
    DIGIT,
    HALF,
    LOSS_UNIT,
    SHARES,
    UNIT,
    Block,
    BoostingParams,
    QuantileModel,
    Tree,
    _best_split,
    _bin_type,
    blocks,
    candidates,
    merged,
    prepare,
    shared,
    unsorted,
    with_predictions,
)


@dataclass
class Trial:
    """One candidate and what it has grown."""

    number: int
    params: BoostingParams
    model: QuantileModel
    draw: random.Random
    done: list[Tree] = field(default_factory=list)
    best: float = math.inf
    best_rounds: int = 0
    rounds: int = 0
    finished: bool = False

    def grown(self) -> QuantileModel:
        self.model.trees = self.model.trees[: self.best_rounds]
        return self.model


@dataclass(frozen=True)
class Rung:
    """Losses after so many rounds and the trials that went on, best first."""

    rounds: int
    losses: dict[int, float]
    kept: list[int]


@dataclass
class Search:
    params: BoostingParams
    model: QuantileModel
    number: int
    rungs: list[Rung]


def rung_rounds(trials: int, rounds: int) -> list[int]:
    """Rounds after which half of the trials go: each rung doubles them, the last ends below ``rounds``."""
    steps = math.ceil(math.log2(max(trials, 1)))
    return sorted({max(1, rounds >> (steps - i)) for i in range(steps)})


class _Rows:
    """The training state of all live trials: blocks of cells with one prediction per slot."""

    def __init__(self, rows: DataFrame, n: int, bounds, base: float, trials: Sequence[Trial]):
        self.n, self.bounds, self.slots = n, bounds, [t.number for t in trials]
        self.state = rows.withColumn("__pred", F.lit(base))

    def each(self, trials: Sequence[Trial]) -> Callable[[pa.RecordBatch], Iterator[tuple[Block, Iterator[tuple[int, np.ndarray]]]]]:
        """The blocks of a batch, each with the trials' numbers and predictions of its cells."""
        n, kind, slots = self.n, _bin_type(self.bounds), {s: i for i, s in enumerate(self.slots)}
        plan = [(t.number, slots[t.number], list(t.done), t.params.learning_rate) for t in trials]
        width = len(self.slots)

        def read(batch: pa.RecordBatch):
            for block in blocks(batch, n, kind, width):
                yield block, ((number, block.prediction(done, rate, slot)) for number, slot, done, rate in plan)

        return read

    def advance(self, trials: Sequence[Trial]) -> None:
        """Store the predictions of the live trials; the others' are dropped."""
        read = self.each(trials)
        self.state = with_predictions(self.state, lambda batch: (np.column_stack([p for _, p in found]) for _, found in read(batch)))
        self.slots = [t.number for t in trials]
        for trial in trials:
            trial.done = []


def _level_sums(rows: _Rows, sample: DataFrame, width: int, up: int, growing: dict[int, tuple[Trial, Tree, list[int]]]):
    """Counts and gradient sums per (node, feature, bin) of one level of every growing trial."""
    n, read = rows.n, rows.each([t for t, _, _ in growing.values()])
    plan = {number: (tree, nodes, round(trial.params.row_fraction * SHARES)) for number, (trial, tree, nodes) in growing.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for number, (tree, nodes, _) in plan.items():
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            size = len(nodes) * n * width
            totals[number] = slot, np.zeros(size), np.zeros(size)
        for batch in batches:
            for block, found in read(batch):
                for number, prediction in found:
                    (tree, _, limit), (slot, counts, sums) = plan[number], totals[number]
                    block.add_level(slot[tree.leaves(block.bins)], *block.gradients(prediction, up, limit), width, counts, sums)
        for number, (_, counts, sums) in totals.items():
            some = np.flatnonzero(counts)
            columns = [np.full(len(some), number), some, counts[some].astype(np.int64), sums[some].astype(np.int64)]
            yield pa.record_batch(columns, ["trial", "at", "n", "g"])

    added = sample.drop("__rows").mapInArrow(add, "trial bigint, at bigint, n bigint, g bigint")
    added = added.groupBy("trial", "at").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    trial, at, count, total = (c.to_numpy() for c in added.toArrow().columns)
    out = {}
    for number, (_, nodes, _) in plan.items():
        counts, sums = np.zeros((len(nodes), n, width)), np.zeros((len(nodes), n, width))
        own = trial == number
        counts.flat[at[own]], sums.flat[at[own]] = count[own], total[own]
        out[number] = counts, sums
    return out


def _grow(rows: _Rows, trials: Sequence[Trial], width: int, up: int, step: int, seed: int) -> dict[int, Tree]:
    """The next tree of every trial, level by level; a pass serves all that still grow."""
    n = rows.n
    learn = rows.state.filter("__train")
    sample = shared(learn, seed + step)
    chosen = {t.number: sorted(t.draw.sample(range(n), max(1, round(n * t.params.feature_fraction)))) for t in trials}
    trees = {t.number: Tree() for t in trials}
    growing = {t.number: (t, trees[t.number], [0]) for t in trials}
    leaves = dict.fromkeys(growing, 1)
    level = 0
    while growing:
        sums = _level_sums(rows, sample, width, up, growing)
        level += 1
        after = {}
        for number, (trial, tree, nodes) in growing.items():
            counts, totals = sums[number]
            splits = [(_best_split(counts[i], totals[i], chosen[number], trial.params.min_rows), node) for i, node in enumerate(nodes)]
            splits = sorted(((s, node) for s, node in splits if s), key=lambda x: (-x[0][0], x[1]))[: trial.params.leaves - leaves[number]]
            below: list[int] = []
            for (gain, feature, bin), node in sorted(splits, key=lambda x: x[1]):
                below += tree.split(node, feature, bin, gain)
            leaves[number] += len(splits)
            if below and level < trial.params.depth:
                after[number] = trial, tree, below
        growing = after
    return trees


def _leaf_values(rows: _Rows, trials: Sequence[Trial], trees: dict[int, Tree], quantile: float) -> None:
    """Set every leaf to the exact quantile of its residuals, by counting digits of all trials at once."""
    learn = rows.state.filter("__train")
    prefix: dict[tuple[int, int], int] = {}
    rank: dict[tuple[int, int], int] = {}
    for step in range(64 // DIGIT):
        shift, wanted = 64 - DIGIT * (step + 1), dict(prefix)
        read = rows.each([t for t in trials if not step or any(number == t.number for number, _ in wanted)])

        def count(batches: Iterator[pa.RecordBatch], shift=shift, wanted=wanted, step=step) -> Iterator[pa.RecordBatch]:
            known = {number: np.full(len(tree.feature), -1, np.int64) for number, tree in trees.items()}
            for (number, leaf), value in wanted.items():
                known[number][leaf] = value
            runs: dict[int, list] = {}
            for batch in batches:
                for block, found in read(batch):
                    for number, prediction in found:
                        runs.setdefault(number, []).append(
                            block.digit_runs(prediction, trees[number].leaves(block.bins), shift, known[number] if step else None)
                        )
                        runs[number] = [merged(runs[number])]
            for number, ((code, rows, low, high),) in runs.items():
                columns = [np.full(len(code), number), code >> DIGIT, code & (2**DIGIT - 1), rows, low, high]
                yield pa.record_batch(columns, ["trial", "leaf", "digit", "n", "low", "high"])

        sums = (
            learn.drop("__rows").mapInArrow(count, "trial bigint, leaf bigint, digit bigint, n bigint, low bigint, high bigint")
            .groupBy("trial", "leaf", "digit")
            .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        )
        leaf = Window.partitionBy("trial", "leaf")
        upto = F.sum("n").over(leaf.orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        due = F.ceil(F.sum("n").over(leaf) * F.lit(float(quantile))).cast("long")
        if step:
            ranks = learn.sparkSession.createDataFrame([(*key, value) for key, value in rank.items()], "trial long, leaf long, due long")
            counted = sums.withColumn("upto", upto).join(ranks, ["trial", "leaf"])
        else:
            counted = sums.withColumn("upto", upto).withColumn("due", F.greatest(due, F.lit(1)))
        picked = counted.filter("upto >= due").groupBy("trial", "leaf").agg(F.min(F.struct("digit", "n", "low", "high", "upto", "due")).alias("p"))
        prefix_now, rank_now = {}, {}
        for trial, node, p in picked.collect():
            if p.low == p.high:
                trees[trial].value[node] = float(unsorted(np.array([p.low], np.int64))[0])
            else:
                prefix_now[trial, node] = (prefix.get((trial, node), 0) << DIGIT) | p.digit
                rank_now[trial, node] = p.due - (p.upto - p.n)
        prefix, rank = prefix_now, rank_now
        if not prefix:
            return


def _losses(rows: _Rows, trials: Sequence[Trial], quantile: float) -> dict[int, float]:
    """Mean pinball loss of every trial on the validation rows; none if there are no rows."""
    read = rows.each(trials)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(number, *block.loss(prediction, quantile)) for block, found in read(batch) for number, prediction in found]
            columns = [pa.array(c, pa.int64()) for c in np.reshape(sums, (-1, 4)).T.astype(np.int64)]
            yield pa.record_batch(columns, ["trial", "upper", "lower", "n"])

    left = rows.state.filter("not __train").drop("__rows").mapInArrow(add, "trial bigint, upper bigint, lower bigint, n bigint")
    wide = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    found = left.groupBy("trial").agg(wide("upper"), wide("lower"), F.sum("n").alias("n")).collect()
    return {r.trial: float(int(r.upper) * HALF + int(r.lower)) / LOSS_UNIT / r.n for r in found if r.n}


def halving_search(
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    label: str,
    quantile: float,
    trials: int,
    start: BoostingParams = BoostingParams(),
) -> Search:
    """The best of ``trials`` seeded candidates, and its model.

    Rungs come after the rounds of ``rung_rounds``: the better half (rounded up) by
    least validation loss goes on, of equal losses the lower number. Without labelled validation rows nothing
    can be compared: ValueError. With ``trials`` 0 the start itself is grown.
    """
    drawn = candidates(trials, start) or [start]
    rows, (base,), bounds = prepare(train, valid, features, label, [quantile], start)
    if rows.filter("not __train").isEmpty():
        raise ValueError("no labelled validation rows")
    live = [
        Trial(i, p, QuantileModel(float(quantile), list(features), base, p.learning_rate, bounds), random.Random(p.seed)) for i, p in enumerate(drawn)
    ]
    state = _Rows(rows, len(features), bounds, base, live)
    width, up = max(map(len, bounds), default=0) + 1, round(quantile * UNIT)
    rungs, history = rung_rounds(len(live), start.rounds), []
    for step in range(start.rounds):
        active = [t for t in live if not t.finished]
        if not active:
            break
        trees = _grow(state, active, width, up, step, start.seed)
        _leaf_values(state, active, trees, quantile)
        for trial in active:
            trial.model.trees.append(trees[trial.number])
            trial.done.append(trees[trial.number])
        losses = _losses(state, active, quantile)
        for trial in active:
            trial.rounds = step + 1
            loss = losses[trial.number]
            trial.model.losses.append(loss)
            if loss < trial.best:
                trial.best, trial.best_rounds = loss, step + 1
            trial.finished = step + 1 - trial.best_rounds >= trial.params.early_stopping
        if step + 1 in rungs and len(live) > 1:
            ranked = sorted(live, key=lambda t: (t.best, t.number))
            kept = ranked[: math.ceil(len(ranked) / 2)]
            history.append(Rung(step + 1, {t.number: t.best for t in ranked}, [t.number for t in kept]))
            live = kept
        active = [t for t in live if not t.finished]
        if active and max(len(t.done) for t in active) * len(active) >= start.checkpoint_every:
            state.advance(active)
    winner = min(live, key=lambda t: (t.best, t.number))
    return Search(winner.params, winner.grown(), winner.number, history)
