"""Quality classifier: naive Bayes support vectors.

A document is the set of its hashed n-grams (words, pairs of words, pairs of a
word and its repeat, runs of character classes). Each indicator is scaled by the
log ratio of its smoothed counts in the two classes; the vectors have length one;
a linear model with hinge loss is fitted to them by dual coordinate descent, and
a logistic curve through a held-back fifth turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.words import grams, hash_slices, mix, owners, passes, split_words, text_bytes


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled rows that the model is fitted to; all else covers all rows.

    The rows are those with the smallest hash of their id. ``buckets`` is the
    width of the hashed n-grams and so of the model; ``folds`` parts of the ids
    by crc32, of which part 0 is never learned from.
    """

    fit_rows: int = 20_000
    buckets: int = 1 << 18
    folds: int = 5
    smoothing: float = 1.0
    cost: float = 1.0
    sweeps: int = 8
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Margin of a text: sum of ``scaled`` over its n-grams, divided by the root of the sum of ``squares``, plus ``bias``."""

    scaled: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float


def _classes() -> np.ndarray:
    table = np.full(256, 1, np.uint8)
    table[65:91] = 2
    table[48:58] = 3
    table[[0x20, *range(0x09, 0x0E)]] = 4
    table[10] = 5
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = np.arange(6, 6 + len(marks))
    return table


CLASSES = _classes()

#: Bytes of text per pass; a text's n-grams take some hundred times their bytes for a moment.
PASS_BYTES = 1 << 19


def indicators(buffer: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-grams of each text, sorted."""
    starts, ends, word_bounds = split_words(buffer, bounds)
    words = hash_slices(buffer, starts, ends)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(word_bounds))
    found = [(owner, words)]
    at, doc = owners(word_bounds, 2)
    if len(at):
        found.append((doc, grams(words, 2)[at]))
        again = doc[words[at] == words[at + 1]]
        found.append((again, np.full(len(again), mix(np.array([99], np.uint64))[0])))
    kinds = CLASSES[buffer]
    change = np.ones(len(kinds), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[bounds[:-1][bounds[:-1] < len(kinds)]] = True
    places = np.flatnonzero(change)
    runs = mix(kinds[places].astype(np.uint64) + np.uint64(1000))
    run_bounds = np.searchsorted(places, bounds)
    for k in (1, 3, 5):
        at, doc = owners(run_bounds, k)
        if len(at):
            found.append((doc, grams(runs, k)[at] + np.uint64(k)))
    texts = np.concatenate([d for d, _ in found])
    hashes = np.concatenate([h for _, h in found])
    pairs = texts.astype(np.int64) * buckets + (mix(hashes) % np.uint64(buckets)).astype(np.int64)
    pairs = np.unique(pairs)
    return pairs // buckets, pairs % buckets


def held_out(id: str, folds: int) -> Column:
    """Whether an id is in the part that is never learned from; a null id is."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % folds == 0


def labelled(labels: DataFrame, settings: Settings, id: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most ``fit_rows`` (id, label, place) of the learnable part.

    Of repeated ids the smaller label counts; null ids and labels other than 0 and 1 are left out.
    """
    return (
        labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id, settings.folds))
        .groupBy(F.col(id))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
        .withColumn("place", F.xxhash64(F.lit(settings.seed), F.col(id)))
        .orderBy("place", id)
        .limit(settings.fit_rows)
    )


def _descend(rows: list[np.ndarray], ratio: np.ndarray, scales: np.ndarray, signs: np.ndarray, costs: np.ndarray, sweeps: int, seed: int):
    """Weights and bias of the hinge-loss model: one dual variable at a time, in seeded order.

    The vector of a row is ``ratio`` at its buckets times its scale; its length is one.
    """
    weights, bias, duals = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(sweeps):
        for i in draw.permutation(len(rows)):
            at, y = rows[i], signs[i]
            x = ratio[at] * scales[i]
            gradient = y * (weights[at] @ x + bias) - 1.0
            new = min(max(duals[i] - gradient / 2.0, 0.0), costs[i])
            step = (new - duals[i]) * y
            if step:
                weights[at] += step * x
                bias += step
                duals[i] = new
    return weights, bias


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through smoothed labels, by Newton steps."""
    up, down = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - p))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """Fit to documents given as bucket arrays. Without both classes every text gets the share of label 1, or 0.5."""
    width = settings.buckets
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(width), np.ones(width), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.full((2, width), settings.smoothing)
    for at, label in zip(rows, labels, strict=True):
        counts[label, at] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    norms = np.array([np.sqrt(ratio[at] @ ratio[at]) for at in rows])
    scales = 1.0 / np.where(norms > 0, norms, 1.0)
    signs = np.where(labels == 1, 1.0, -1.0)
    balance = np.bincount(labels, minlength=2)
    costs = settings.cost * len(labels) / (2.0 * balance[labels])
    back = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~back) if (~back).any() and len(set(labels[~back])) == 2 and back.any() else np.arange(len(rows))
    weights, bias = _descend([rows[i] for i in learn], ratio, scales[learn], signs[learn], costs[learn], settings.sweeps, settings.seed)
    judged = np.flatnonzero(back) if len(learn) < len(rows) else learn
    margins = np.array([(weights[rows[i]] @ ratio[rows[i]]) * scales[i] + bias for i in judged])
    slope, offset = _curve(margins, labels[judged])
    return Model(weights * ratio, ratio**2, float(bias), slope, offset)


def fit(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> Model:
    """Learn from the labelled rows of ``df``; the chosen ids, their n-grams and the model are all bounded.

    The n-grams of the chosen rows meet in one task, at most ``fit_rows`` of them,
    since dual coordinate descent walks them in turn; the driver gets the model. Of
    rows that share an id only the text with the smallest hash counts, so repeats
    cannot pass that bound; they are dropped before any text travels whole.
    """
    names = settings

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, limit=PASS_BYTES):
                texts, found = indicators(*text_bytes(part.column("text")), names.buckets)
                cuts = np.searchsorted(texts, np.arange(part.num_rows + 1))
                cells = [found[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch(
                    [part.column("place"), part.column("label"), pa.array(cells, pa.binary())], ["place", "label", "cells"]
                )

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "cells"], kind="stable")
        model = fit_rows([np.frombuffer(c, np.int32) for c in rows["cells"]], rows["label"].to_numpy(), names)
        return pd.DataFrame(
            {"scaled": [model.scaled.tobytes()], "squares": [model.squares.tobytes()], "bias": [model.bias], "slope": [model.slope], "offset": [model.offset]}
        )

    chosen = F.broadcast(labelled(labels, settings, id))
    rows = (
        df.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(chosen, id)
        .groupBy(id, "place", "label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
        .select("place", "label", "first.text")
        .mapInArrow(read, "place bigint, label int, cells binary")
    )
    found = (
        rows.groupBy()
        .applyInPandas(learn, "scaled binary, squares binary, bias double, slope double, offset double")
        .collect()
    )
    if not found:
        return fit_rows([], np.empty(0, np.int64), settings)
    m = found[0]
    return Model(np.frombuffer(m.scaled), np.frombuffer(m.squares), m.bias, m.slope, m.offset)


def probabilities(model: Model, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    texts, found = indicators(buffer, bounds, len(model.scaled))
    total = np.bincount(texts, model.scaled[found], minlength=n)
    norm = np.sqrt(np.bincount(texts, model.squares[found], minlength=n))
    margins = total / np.where(norm > 0, norm, 1.0) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margins + model.offset, -30, 30)))


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row; null texts count as empty and get the model's bias.

    All other columns pass through unread; one called like the new column is replaced.
    """
    kept = [c for c in df.columns if c != column]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, text, PASS_BYTES):
                values = probabilities(shared.value, *text_bytes(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], [*part.schema.names, column])

    rows = df.select(kept)
    return rows.mapInArrow(judge, rows.withColumn(column, F.lit(0.0)).schema)


def classify(
    df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", least: float = 0.3
) -> DataFrame:
    """The rows of ``df`` with held_out, score and predicted (1 from ``least`` on).

    Every row is judged: null and empty texts get the score of a text without
    n-grams, equal texts equal scores, repeated rows repeated results. A null id is
    held out. Without labels of both classes all texts get the share of label 1
    (0.5 without any). Other columns pass through; those named like a result are replaced.
    """
    scored = score(df, fit(df, labels, settings, id, text), text)
    return scored.withColumn("held_out", held_out(id, settings.folds)).withColumn(
        "predicted", (F.col("score") >= least).cast("int")
    )
