"""Labelled rows to fit a classifier on, and the calibration of its margins.

The fit uses a bounded sample: the ``SAMPLE_ROWS`` labelled documents whose hashed ids are lowest,
without those of the held-out fold (crc32 of the id as text, modulo 5, is 0). Nothing else about a
document's row than its text reaches a classifier.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.catalog import in_arrow, narrow, raw_texts

SAMPLE_ROWS = 8000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, features: Callable, rows: int = SAMPLE_ROWS):
    """Features and labels of the sample, in a fixed order: lists of arrays, and a 0/1 array.

    Labels other than 0 and 1 are left out; of several labels of a document the lowest counts, of
    several texts the first in byte order, so an id that many rows share is one row of the sample.
    Without any labelled row both are empty.
    """
    known = (
        narrow(labels, "doc_id", "quality")
        .filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        # Labels of documents that are not there take no place in the sample.
        .join(narrow(docs, "doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` pairs of numbers, whatever the size of the corpus.
    matched = narrow(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    chosen = matched.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        found = [features(t).astype("<u4").tobytes() for t in raw_texts(batch)]
        return {"doc_id": batch.column("doc_id"), "y": batch.column("quality"), "x": found}

    got = in_arrow(chosen, work, "doc_id bigint, y int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = [np.frombuffer(bytes(r.x), dtype="<u4") for r in got]
    return x, np.array([r.y for r in got], dtype=np.int64)


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities (Newton's method).

    Targets are drawn towards the middle by one case of each class, so separable margins stay
    finite.
    """
    if len(y) == 0:
        return 0.0, 0.0
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.std(margins)) or 1.0
    m = margins / scale
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        norm = np.abs(step).max()
        step = step if norm <= 2 else step * 2 / norm
        a, b = a - step[0], b - step[1]
        if norm < 1e-8:
            break
    return a / scale, b


def probability(margin: float, curve: tuple[float, float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(curve[0] * margin + curve[1], -30, 30))))
