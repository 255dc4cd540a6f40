"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; boosting goes round the features, and
every step fits a shallow tree to the residuals over one feature's bins, added
into that feature's lookup table. Then the pairs whose residuals a cut of both
features explains best get tables of their own, boosted in the same way. A text's
score is a sum of table entries, looked up for a batch at a time.

Only the fit is on a bounded sample (SAMPLE labelled rows, those with the smallest
hashes of their ids); its features are computed from whole texts in Spark, and a
table of floats of that many rows comes to the driver. Every whole text is scored.

Defined cases: a null text is empty; an empty text has features of 0 and a score
like any other; labels that are null or neither 0 nor 1 teach nothing; without
labels all scores are 0.5; a null id is held out; empty tables give no rows.
Results are in one struct column, which replaces a column of its name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobloom.llm.common import appended, chunks, text_bytes, with_field

SAMPLE = 16_384
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.15, 4
#: Least weight (sum of p(1-p)) that a leaf rests on, and what is added to it.
LEAF_WEIGHT, SHRINK = 1.0, 1.0
HELD_OUT = 5
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "symbols", "stops", "digits", "beyond_ascii",
    "distinct_words", "most_frequent", "same_as_before", "distinct_pairs", "log_line", "distinct_lines",
    "ends_in_symbol", "short_words", "blank")

_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KINDS[33:127] = np.where(_KINDS[33:127] == 1, 1, 2)
_KINDS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
_KINDS[[ord(c) for c in ".,;:?'\"-()"]] = 3
_KINDS[[ord(c) for c in "0123456789"]] = 4
_KINDS[128:] = 5
_KINDS[[9, 10, 11, 12, 13, 32]] = 6
_SYMBOLS = b"!#$%&*+/<=>@\\^_`{|}~"


def features(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=7) / size
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    pairs = set(zip(words, words[1:]))
    return [
        np.log1p(size), np.log1p(n), (size * (1 - kinds[6])) / n, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        len(pairs) / max(1, n - 1), np.log1p(size / len(lines)), len(set(lines)) / len(lines),
        sum(w[-1] in _SYMBOLS for w in words) / n, sum(len(w) <= 3 for w in words) / n, kinds[6]]


def _leaves(gradient: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """A tree with up to `most` leaves over the bins in order: the value of each bin."""
    edges = [(0, len(gradient))]

    def best(a: int, b: int):
        g, w = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
        left, right = w[:-1], w[-1] - w[:-1]
        gain = g[:-1] ** 2 / (left + SHRINK) + (g[-1] - g[:-1]) ** 2 / (right + SHRINK) - g[-1] ** 2 / (w[-1] + SHRINK)
        gain = np.where((left >= LEAF_WEIGHT) & (right >= LEAF_WEIGHT), gain, 0)
        return (float(gain.max(initial=0)), a + 1 + int(gain.argmax())) if b - a > 1 else (0.0, b)

    while len(edges) < most:
        (gain, cut), part = max((best(*e), e) for e in edges)
        if gain <= 1e-9:
            break
        edges.remove(part)
        edges += [(part[0], cut), (cut, part[1])]
    value = np.zeros(len(gradient))
    for a, b in edges:
        value[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + SHRINK)
    return value


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes into four: its gain, and the value of each cell."""
    def corners(x):
        low = np.cumsum(np.cumsum(x, 0), 1)
        row, col, all_ = low[:-1, -1:], low[-1:, :-1], low[-1, -1]
        a = low[:-1, :-1]
        return np.stack([a, row - a, col - a, all_ - row - col + a])

    g, w = corners(gradient), corners(weight)
    gain = (g ** 2 / (w + SHRINK)).sum(0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = np.zeros(gradient.shape)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                      (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        value[rows, cols] = g[k, i, j] / (w[k, i, j] + SHRINK)
    return float(gain[i, j]), value


@dataclass
class Model:
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        wide = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (i, j), table in self.pairs.items():
            total += table[wide[i], wide[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    model.edges = [_cuts(c, BINS) for c in x.T]
    model.coarse = [_cuts(c, PAIR_BINS) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    wide = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T)]
    total = np.full(len(y), model.start)

    def residuals():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, w = residuals()
            value = RATE * _leaves(np.bincount(fine[j], g, len(table)), np.bincount(fine[j], w, len(table)), LEAVES)
            table += value
            total += value[fine[j]]

    def sums(i, j):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = wide[i] * shape[1] + wide[j]
        g, w = residuals()
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, w)], cell

    usable = [j for j in range(x.shape[1]) if len(model.coarse[j])]
    ranked = sorted(((_quadrants(*sums(i, j)[0])[0], i, j) for i in usable for j in usable if i < j), reverse=True)
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            (g, w), cell = sums(i, j)
            value = RATE * _quadrants(g, w)[1]
            table += value
            total += value.ravel()[cell]
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out, a null id with it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Learn labels.quality from the texts of up to `rows` labelled documents of the training folds."""
    sample = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select(
        F.col("doc_id").alias("_labelled"), F.col("quality").cast("int").alias("_label")
    ).orderBy(F.xxhash64("_labelled"), "_labelled").limit(rows)  # so the broadcast is bounded

    def measure(batches):
        for batch in chunks(batches, "text"):
            x = np.array([features(t) for t in text_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_label"), *map(pa.array, x.T)], names=["label", *FEATURES])

    rows_of = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled"))
    found = rows_of.select("text", "_label").mapInArrow(
        measure, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    found = found.sort_values(list(found.columns))  # reruns agree
    return fit(found[list(FEATURES)].to_numpy(), found["label"].to_numpy())


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def classify(docs: DataFrame, model: Model, out: str = "quality_model") -> DataFrame:
    """docs (text, ...) with a struct: score (0 to 1) and predicted (score >= 0.3)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        for batch in chunks(batches, "text"):
            x = np.array([features(t) for t in text_bytes(batch.column("text"))])
            score = shared.value.score(x)
            yield appended(batch, out, pa.StructArray.from_arrays(
                [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["score", "predicted"]))

    return docs.mapInArrow(add, with_field(docs.schema, out, RESULT))
