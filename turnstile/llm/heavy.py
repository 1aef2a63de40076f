"""Values that many documents share, found with a bounded result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.words import passes, text_bytes

Values = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def heavy_values(df: DataFrame, values: Values, share: float, least: int = 64) -> np.ndarray:
    """Sorted 64-bit values that about ``share`` of the documents or more hold, and at least ``least``.

    ``df`` has a column ``text``; ``values`` gives the values of some texts and
    the index of each one's text. Every document is counted; a task reports the
    values that reach the share, and two documents, in one of its passes. With v
    values per document there are at most v / share results, whatever the size of
    the input. They steer the balance of work only: no result depends on them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                found, texts = values(*text_bytes(part.column("text")))
                order = np.lexsort((texts, found))
                found, texts = found[order], texts[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (texts[1:] != texts[:-1])
                distinct, counts = np.unique(found[new], return_counts=True)
                many = counts >= max(2, part.num_rows * share)
                yield pa.record_batch([distinct[many].view(np.int64), counts[many]], ["value", "n"])

    rows = df.select("text")
    needed = max(least, rows.count() * share)
    sums = rows.mapInArrow(count, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    found = sums.filter(F.col("n") >= needed).select("value").collect()
    return np.sort(np.array([r.value for r in found], np.int64).view(np.uint64))


def among(values: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``heavy``."""
    if not len(heavy):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
    return heavy[at] == values
