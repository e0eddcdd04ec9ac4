"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Indicators of byte trigrams, words and word pairs are scaled by the logarithm of the ratio of their
shares in the two classes; a linear model with hinge loss is fitted on them by dual coordinate
descent, blended with its mean weight, and its margins are calibrated to probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.catalog import in_arrow, narrow, query, raw_texts, table
from tidings.llm.labelled import SAMPLE_ROWS, calibrated, held_out, probability, sample
from tidings.llm.words import U64, mix, spans, span_hashes, windows

BITS = 18
#: Added to every count before the ratio is taken.
SMOOTHING = 1.0
#: Bound of a dual variable; that of the rarer class is raised by the ratio of the classes.
PENALTY = 1.0
EPOCHS = 15
#: Share of the fitted weights; the rest is their mean size along the log-count ratios.
BLEND = 0.75
#: Label 1 is predicted from this probability on.
THRESHOLD = 0.3

ROWS = "doc_id bigint, score double, predicted int"


def indicators(text: bytes) -> np.ndarray:
    """Buckets of the n-grams that a text holds, each once."""
    data = np.frombuffer(text, dtype=np.uint8)
    wide = data.astype(np.uint32)
    grams = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    chars = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    hashes = span_hashes(data, *spans(data))
    words = np.concatenate([hashes, windows(hashes, 2) + U64(2), repeats(hashes)])
    return np.unique(np.concatenate([chars, (mix(words) >> U64(64 - BITS)).astype(np.uint32)]))


def repeats(hashes: np.ndarray) -> np.ndarray:
    """Indicators of the pair "a word and itself", whatever the word, at counts 1, 2, 4, 8 ..."""
    found = int((hashes[1:] == hashes[:-1]).sum()).bit_length()
    return U64(3) + np.arange(found, dtype=U64)


class NaiveBayesSvm:
    """Weights per bucket, already scaled by the ratios, and the calibration curve."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float):
        self.ratios, self.bias = ratios.astype(np.float32), bias
        self.scaled = (ratios * weights).astype(np.float32)
        self.curve = (0.0, 0.0)

    def margin(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        norm = float(np.sqrt(np.dot(r, r))) or 1.0
        return float(self.scaled[x].sum()) / norm + self.bias

    def score(self, text: bytes) -> float:
        return probability(self.margin(indicators(text)), self.curve)


def log_count_ratios(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per bucket, log of its smoothed share among class 1 over that among class 0."""
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for k in (0, 1):
        rows = [xi for xi, yi in zip(x, y) if yi == k]
        if rows:
            counts[k] += np.bincount(np.concatenate(rows), minlength=1 << BITS)
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(x: list[np.ndarray], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss; rows are scaled to length one, with a bias of one."""
    sign = np.where(y == 1, 1.0, -1.0)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    bound = PENALTY * np.where(y == 1, max(1.0, n0 / n1), max(1.0, n1 / n0))
    values = []
    for xi in x:
        v = ratios[xi]
        values.append(v / (np.sqrt(v @ v) or 1.0))
    diagonal = [v @ v + 1.0 for v in values]
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in order.permutation(len(x)):
            xi, v = x[i], values[i]
            gradient = sign[i] * (w[xi] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                worst = max(worst, abs(step))
                w[xi] += step * v
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def train(x: list[np.ndarray], y: np.ndarray) -> NaiveBayesSvm:
    """Fit on four fifths of the rows, calibrate on the others. Without rows every score is 0.5."""
    if not len(x):
        return NaiveBayesSvm(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0)
    inner = np.arange(len(x)) % 5 != 0
    fit = [xi for xi, k in zip(x, inner) if k]
    ratios = log_count_ratios(fit, y[inner])
    w, bias = descend(fit, y[inner], ratios)
    used = w != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    model = NaiveBayesSvm(ratios, BLEND * w + (1 - BLEND) * mean * used, bias)
    rest = [xi for xi, k in zip(x, inner) if not k] or fit
    known = y[~inner] if (~inner).any() else y[inner]
    model.curve = calibrated(np.array([model.margin(xi) for xi in rest]), known)
    return model


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> NaiveBayesSvm:
    return train(*sample(docs, labels, indicators, rows))


def scored(docs: DataFrame, model: NaiveBayesSvm, threshold: float = THRESHOLD) -> DataFrame:
    """Score and prediction for every document.

    ``docs`` has doc_id and text; other columns are ignored. A null text is scored as the empty
    one: by the bias alone. A null doc_id stays null; repeated rows give repeated rows; an empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two floats per bucket

    def work(batch):
        scores = [held.value.score(t) for t in raw_texts(batch)]
        predicted = [int(s >= threshold) for s in scores]
        return {"doc_id": batch.column(0), "score": scores, "predicted": predicted}

    return in_arrow(narrow(docs, "doc_id", "text"), work, ROWS)


@query("op1_nb_svm_quality")
def op1_nb_svm_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
