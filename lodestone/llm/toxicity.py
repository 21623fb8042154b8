"""Toxicity as a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of bytes in the lower-cased text. Its value is the log ratio of smoothed
counts in toxic and other documents; a logistic regression on these values is trained by full-batch gradient descent.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_rows

#: Lengths of the n-grams in bytes, and the bits of their hash.
SIZES, BITS = (4, 5, 6), 20
#: Labelled rows that the model is fitted on at most of each class, taken in the order of a hash of their key.
FIT_ROWS = 1_200
#: Bytes hashed at once; n-grams across two blocks are kept.
BLOCK = 1 << 18
_MIX = np.uint32(2654435761)


def features(text: str) -> np.ndarray:
    """The sorted distinct hashed n-grams of the whole text, which is lower-cased, its white space single spaces."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8)
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + max(SIZES) - 1].astype(np.uint32)
        rolled = np.zeros(len(part), np.uint32)
        for size in range(1, max(SIZES) + 1):
            if len(part) < size:
                break
            rolled = rolled[: len(part) - size + 1] * np.uint32(0x01000193) + (part[size - 1 :] + np.uint32(1)) * np.uint32(size * 2 + 1)
            if size in SIZES:
                seen[((rolled ^ (rolled >> np.uint32(15))) * _MIX) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


def fit(rows: list[tuple[np.ndarray, int]], steps: int = 100, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) from (features, label) rows. Without rows of both labels every score is the smoothed share."""
    weights = np.zeros(1 << BITS, np.float32)
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(rows) + 1)
        return weights, float(np.log(share / (1 - share)))
    counts = [np.bincount(np.concatenate([x for x, y in rows if y == c]), minlength=1 << BITS) for c in (0, 1)]
    sizes = [(labels == c).sum() for c in (0, 1)]
    ratio = np.log((counts[1] + 0.5) / (sizes[1] + 1.0)) - np.log((counts[0] + 0.5) / (sizes[0] + 1.0))
    # N-grams of a document or two tell nothing of others, and those as frequent in both classes have no weight.
    ratio[(counts[0] + counts[1] < 3) | (np.abs(ratio) < 0.5)] = 0
    used = np.flatnonzero(ratio)
    if not len(used):
        return weights, 0.0
    kept = [x[ratio[x] != 0] for x, _ in rows]
    at = np.repeat(np.arange(len(rows)), [len(x) for x in kept])
    columns = np.searchsorted(used, np.concatenate(kept))
    values = ratio[used][columns]
    scale = 1 / max(1.0, float(np.mean(np.bincount(at, values * values, len(rows)))))
    w, bias, speed, push = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    share = labels.mean()
    each = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    for _ in range(steps):
        margin = np.bincount(at, w[columns] * values, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * each
        slope = np.bincount(columns, error[at] * values, len(used)) + decay * w * scale
        speed = 0.9 * speed - rate * scale * 4 * slope
        push = 0.9 * push - rate * error.sum()
        w, bias = w + speed, bias + push
    weights[used] = w * ratio[used]
    return weights, float(bias)


def score(model: tuple[np.ndarray, float], text: str) -> float:
    weights, bias = model
    return float(1 / (1 + np.exp(-np.clip(weights[features(text)].sum(dtype=np.float64) + bias, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """The model of at most FIT_ROWS labelled rows of each class where ``learn`` holds; executors make the features."""

    def make():
        return lambda value, y: [(features(value).tobytes(), y)]

    sample = map_rows(labelled_sample(docs, labels, label, FIT_ROWS, learn, key, text), ["text", label], "x binary, y int", make)
    got = sorted((bytes(r.x), r.y) for r in sample.toLocalIterator())
    return fit([(np.frombuffer(x, np.int32), y) for x, y in got])


def classify(df: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, score, predicted) of every row from its whole text alone. Null texts are empty, and an empty text scores
    what the bias says; repeated rows give repeated rows; a null key stays; other columns aren't carried. The model has
    a fixed size, whatever the data."""
    used = np.flatnonzero(model[0])
    sent = df.sparkSession.sparkContext.broadcast((used, model[0][used], model[1]))

    def make():
        at, weights, bias = sent.value
        own = np.zeros(1 << BITS, np.float32)
        own[at] = weights

        def each(k, value):
            p = score((own, bias), value or "")
            yield k, p, int(p >= least)

        return each

    kind = df.select(key).schema[0].dataType.simpleString()
    return map_rows(df, [key, text], f"`{key}` {kind}, score double, predicted int", make)
