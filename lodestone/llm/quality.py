"""Quality by a convolutional network over bytes, in numpy.

The whole document is cut into overlapping chunks. Learned filters of WIDTH bytes slide over each chunk; each filter's
largest answer in a chunk is kept (max pooling). The mean and the largest of these over all chunks go through one linear
layer to one probability. A filter on one-hot bytes is a table of a weight for each place and byte, so a convolution is
a sum of table rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, labelled_sample, map_rows

#: Filter width in bytes, number of filters, chunk length and the distance between chunk starts.
WIDTH, FILTERS, CHUNK, STEP = 6, 12, 256, 250
#: Labelled rows of each class that the network is fitted on at most, taken in the order of a hash of their key.
FIT_ROWS = 700
#: Chunks convolved at once.
AT_ONCE = 256


def chunks(text: str) -> np.ndarray:
    """Rows of CHUNK + 1 byte values; 256 stands for no byte. Every WIDTH consecutive bytes are in some row."""
    data = np.frombuffer(text.encode(), np.uint8)
    rows = max(1, -(-max(0, len(data) - (CHUNK - STEP)) // STEP))
    padded = np.full((rows - 1) * STEP + CHUNK, 256, np.uint16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def pooled(filters: np.ndarray, rows: np.ndarray, where: bool = False):
    """The largest answer of each filter in each row, not under 0, and with ``where`` also its place."""
    best, places = [], []
    for at in range(0, len(rows), AT_ONCE):
        part = rows[at : at + AT_ONCE]
        wide = part.shape[1] - WIDTH + 1
        out = filters[0][part[:, :wide]]
        for k in range(1, WIDTH):
            out += filters[k][part[:, k : k + wide]]
        if where:
            places.append(out.argmax(1))
        best.append(out.max(1))
    best = np.maximum(np.concatenate(best), 0)
    return (best, np.concatenate(places)) if where else best


def _document(z: np.ndarray) -> np.ndarray:
    return np.concatenate([z.mean(0), z.max(0)])


def _passage(text: str, rng: np.random.Generator) -> str:
    words = text.split()
    count = int(rng.integers(1, 16))
    start = int(rng.integers(0, max(1, len(words) - count)))
    return " ".join(words[start : start + count])


class Network:
    """filters[place, byte, filter], the linear layer and its bias."""

    def __init__(self, filters: np.ndarray, out: np.ndarray, bias: float):
        self.filters, self.out, self.bias = filters.astype(np.float32), out.astype(np.float64), float(bias)

    def score(self, text: str) -> float:
        z = _document(pooled(self.filters, chunks(text)))
        return float(1 / (1 + np.exp(-np.clip(z @ self.out + self.bias, -30, 30))))


def fit(rows: list[tuple[str, int]], prior: float | None = None, rounds: int = 8, batch: int = 16, rate: float = 0.02, seed: int = 5) -> Network:
    """Trained by Adam on (text, label) rows, both classes with the same weight; ``prior``, the share of label 1 among
    all labelled rows, then moves the bias. Without rows of both labels every score is that share."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], float)
    share = prior if prior is not None else (labels.sum() + 0.5) / (len(rows) + 1)
    odds = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    filters = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
    filters[:, 256] = 0
    if not rows or labels.min() == labels.max():
        return Network(filters, np.zeros(2 * FILTERS), odds)
    # A short passage of a good document is good as well; without such rows short texts would be rejected.
    rows = rows + [(_passage(t, rng), 1) for t, y in rows if y == 1]
    labels = np.array([y for _, y in rows], float)
    out, bias = rng.normal(0, 0.3, 2 * FILTERS), 0.0
    cut = [chunks(t) for t, _ in rows]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (filters, out, np.zeros(1))]
    step, rounds = 0, max(rounds, -(-400 * batch // len(rows)))
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            ids = order[start : start + batch]
            d_filters, d_out, d_bias = np.zeros_like(filters), np.zeros_like(out), np.zeros(1)
            z, places = pooled(filters, np.concatenate([cut[i] for i in ids]), True)
            at = 0
            for i in ids:
                own, place, part = z[at : at + len(cut[i])], places[at : at + len(cut[i])], cut[i]
                at += len(part)
                x = _document(own)
                error = (1 / (1 + np.exp(-np.clip(x @ out + bias, -30, 30))) - labels[i]) * weight[i] / len(ids)
                d_out += error * x
                d_bias += error
                flow = np.tile(error * out[:FILTERS] / len(own), (len(own), 1))
                flow[own.argmax(0), np.arange(FILTERS)] += error * out[FILTERS:]
                flow[own <= 0] = 0
                for k in range(WIDTH):
                    np.add.at(d_filters[k], (np.take_along_axis(part, place + k, 1), np.arange(FILTERS)), flow)
            step += 1
            d_filters += 1e-5 * filters
            d_out += 1e-4 * out
            moves = []
            for s, d in zip(state, (d_filters, d_out, d_bias)):
                s[0] += 0.1 * (d - s[0])
                s[1] += 0.01 * (d * d - s[1])
                moves.append(rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8))
            filters -= moves[0]
            filters[:, 256] = 0
            out, bias = out - moves[1], bias - float(moves[2][0])
    return Network(filters, out, bias + odds)


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", key: str = "doc_id", text: str = "text") -> Network:
    """The network of at most FIT_ROWS labelled rows of each class where ``learn`` holds; the share of label 1 is that
    of all rows where it holds."""
    sample = labelled_sample(docs, labels, label, FIT_ROWS, learn, key, text).select("text", F.col(label).alias("y"))
    rows = sorted((r.text, r.y) for r in sample.toLocalIterator())
    share = labels.where(learn & F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit(rows, share)


def classify(df: DataFrame, network: Network, key: str = "doc_id", text: str = "text", least: float = 0.7, carry: bool = False) -> DataFrame:
    """(key, score, predicted) of every row from its whole text alone, or with ``carry`` all columns and these two.
    Null texts are empty, and an empty text is scored like any other; repeated rows give repeated rows; a null key
    stays. With ``carry`` the two are named _score and _predicted, or what common.free() makes of these where the frame
    has such columns. The network has a fixed size."""
    sent = df.sparkSession.sparkContext.broadcast(network)

    def make():
        own = sent.value

        def each(*row):
            p = own.score(row[-1] or "")
            yield (*row[:-1], p, int(p >= least))

        return each

    kept = df.columns if carry else [key]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema)
    names = (free(df, "_score"), free(df, "_predicted")) if carry else ("score", "predicted")
    return map_rows(df, [*kept, text], f"{ddl}, {names[0]} double, {names[1]} int", make)
