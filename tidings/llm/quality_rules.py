"""Quality rules: counts over a text's words and lines, then a calibrated linear model.

The model is a logistic regression over the relative frequencies of hashed word n-grams (one and two
words) and character n-grams (three to five), fitted by adaptive gradient steps on labelled rows,
calibrated on rows it has not seen, and applied in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidings.llm.catalog import in_arrow, narrow, query, raw_texts, table
from tidings.llm.labelled import SAMPLE_ROWS, calibrated, probability, sample
from tidings.llm.words import SPACE, U64, mix, span_hashes, spans, windows

BITS = 18
EPOCHS = 6
RATE = 0.5
#: Frequencies are below one; this brings a usual margin near one.
SCALE = 20.0

#: Fixed thresholds of the rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: A text that passes the rules is kept if label 1 is at least so likely.
MIN_PROBABILITY = 0.3

ROWS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, base_failed boolean, probability double, kept boolean"
)

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS)] = True


class Text:
    """One text taken apart once, for the rules and the model."""

    def __init__(self, text: bytes):
        self.raw = text
        self.data = np.frombuffer(text, dtype=np.uint8)
        starts, ends = spans(self.data)
        self.hashes = span_hashes(self.data, starts, ends)

    def rules(self) -> dict:
        """The counts. Code points are the bytes that do not continue another."""
        visible = ~SPACE[self.data]
        return {
            "n_words": len(self.hashes),
            "word_chars": int((visible & ((self.data & 0xC0) != 0x80)).sum()),
            "n_symbols": int(IS_SYMBOL[self.data].sum()),
            "n_dup_lines": self.repeated_lines(),
            "n_repeat_words": self.repeated_words(),
        }

    def repeated_lines(self) -> int:
        lines = [line for line in self.raw.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
        return len(lines) - len(set(lines))

    def repeated_words(self) -> int:
        """Words in a window that the text holds twice or more."""
        found = windows(self.hashes, REPEAT_WINDOW)
        if not len(found):
            return 0
        _, which, counts = np.unique(found, return_inverse=True, return_counts=True)
        steps = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        again = np.flatnonzero(counts[which] > 1)
        np.add.at(steps, again, 1)
        np.add.at(steps, again + REPEAT_WINDOW, -1)
        return int((np.cumsum(steps) > 0).sum())

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the word n-grams and of the character n-grams, as often as they occur."""
        words = mix(np.concatenate([self.hashes, windows(self.hashes, 2) + U64(2)]))
        characters = self.raw.decode("utf-8", "replace").encode("utf-32-le")
        wide = np.frombuffer(characters, dtype="<u4") + np.uint32(1)
        grams, held = [], wide[:0]
        for n in range(1, 6):
            held = wide if n == 1 else held[:-1] * np.uint32(0x01000193) + wide[n - 1 :]
            if len(held) and n >= 3:
                grams.append((held * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
            if not len(held):
                break
        chars = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint32)
        return (words >> U64(64 - BITS)).astype(np.uint32), chars


def flat_features(text: bytes) -> np.ndarray:
    """Both blocks as one array: the number of word buckets, those, then the character buckets."""
    words, chars = Text(text).blocks()
    return np.concatenate([np.array([len(words)], dtype=np.uint32), words, chars])


class Logistic:
    def __init__(self):
        self.words = np.zeros(1 << BITS, dtype=np.float32)
        self.chars = np.zeros(1 << BITS, dtype=np.float32)
        self.bias, self.curve = 0.0, (0.0, 0.0)

    def margin(self, words: np.ndarray, chars: np.ndarray) -> float:
        out = self.bias
        if len(words):
            out += SCALE * float(self.words[words].mean())
        if len(chars):
            out += SCALE * float(self.chars[chars].mean())
        return out


def train(flat: list[np.ndarray], y: np.ndarray) -> Logistic:
    """Fit on four fifths of the rows, calibrate on the others; both classes weigh the same."""
    model = Logistic()
    if not len(flat):
        return model
    rows = [(f[1 : 1 + f[0]], f[1 + f[0] :]) for f in flat]
    counted = [
        [(*np.unique(b, return_counts=True), len(b)) for b in row if len(b)] for row in rows
    ]
    inner = np.arange(len(rows)) % 5 != 0
    share = np.array([(y[inner] == k).mean() for k in (0, 1)])
    weight = 0.5 / np.maximum(share, 1e-3)
    seen_words, seen_chars = np.full(1 << BITS, 1e-6), np.full(1 << BITS, 1e-6)
    seen_bias = 1e-6
    order = np.random.default_rng(11)
    fit = np.flatnonzero(inner)
    for _ in range(EPOCHS):
        for i in order.permutation(fit):
            p = 1 / (1 + np.exp(-np.clip(model.margin(*rows[i]), -30, 30)))
            slope = (p - y[i]) * weight[y[i]]
            seen_bias += slope * slope
            model.bias -= RATE * slope / np.sqrt(seen_bias)
            blocks = [b for b, r in zip((0, 1), rows[i]) if len(r)]
            for b, (bucket, count, total) in zip(blocks, counted[i]):
                w, seen = (model.words, seen_words) if b == 0 else (model.chars, seen_chars)
                g = slope * SCALE * count / total
                seen[bucket] += g * g
                w[bucket] -= RATE * g / np.sqrt(seen[bucket])
    rest = np.flatnonzero(~inner) if (~inner).any() else fit
    model.curve = calibrated(np.array([model.margin(*rows[i]) for i in rest]), y[rest])
    return model


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Logistic:
    return train(*sample(docs, labels, flat_features, rows // 4))


def judged(docs: DataFrame, model: Logistic) -> DataFrame:
    """Counts and verdict for every document.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text has no words and
    fails the rules; a null doc_id stays null; repeated rows give repeated rows; an empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two floats per bucket

    def work(batch):
        out = []
        for raw in raw_texts(batch):
            text = Text(raw)
            row = text.rules()
            few = row["n_words"] < MIN_WORDS
            row["base_failed"] = few or 100 * row["n_repeat_words"] > MAX_REPEAT_PERCENT * row["n_words"]
            row["probability"] = probability(held.value.margin(*text.blocks()), held.value.curve)
            row["kept"] = not row["base_failed"] and row["probability"] >= MIN_PROBABILITY
            out.append(row)
        return {"doc_id": batch.column(0)} | {k: [r[k] for r in out] for k in out[0]}

    return in_arrow(narrow(docs, "doc_id", "text"), work, ROWS)


@query("op3_ngram_quality_rules")
def op3_ngram_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judged(docs, fitted(docs, labels))
