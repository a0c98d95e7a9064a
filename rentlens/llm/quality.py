"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree per feature and round to the residual, so that each feature ends as
a lookup table over its bins; then the pairs with the largest remaining gain get two-way tables the same
way. A score is the sum of one table entry per feature and pair. The features describe the form of the
whole text only.

The model is fitted on the driver from a bounded sample (``limit`` label rows, a few dozen numbers each).
Null counts as empty; an empty text is scored like any other; with no labels the score is 0.5, with one
class the share of that class, smoothed. Repeated documents are scored each; repeated labels count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm import words
from rentlens.llm.labelled import held_out, labelled_texts

FEATURES = ("length n_words word_length upper digit blank newline symbol bang bar end_mark comma non_ascii "
            "glued distinct_words top_word same_as_last distinct_shingles words_per_line symbol_after_word").split()
_CHUNK = 1 << 22


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


_CLASSES = [
    _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("0123456789"), _marks(" \t\n\r\f\v"), _marks("\n"), _marks("#$%&*@^~=<>{}[]\\/+_"),
    _marks("!"), _marks("|"), _marks(".?!"), _marks(","), np.array([b > 127 for b in range(256)], np.uint8),
]
_LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
_SYMBOL = _CLASSES[4].astype(bool) | _CLASSES[5].astype(bool)
_CLAUSE = _marks(",;:").astype(bool)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _features(texts: pa.Array) -> np.ndarray:
    data, offsets = words.utf8(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.maximum(offsets[1:] - offsets[:-1], 1)
    shares = [_sums(table[data], offsets) for table in _CLASSES]
    after = np.zeros(len(data), np.uint8)
    glued = np.zeros(len(data), np.uint8)
    if len(data) > 1:
        letter = _LETTER[data]
        after[1:] = letter[:-1] & _SYMBOL[data[1:]]
        glued[1:] = _CLAUSE[data[:-1]] & letter[1:]
    hashes, owners, _ = words.word_hashes(data, offsets)
    bounds = words.by_text(owners, n)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    out[:, 0] = np.log1p(offsets[1:] - offsets[:-1])
    out[:, 1] = np.log1p(count)
    out[:, 2] = size / some
    for k, share in enumerate(shares):
        out[:, 3 + k] = share / size
    out[:, 13] = _sums(glued, offsets) / some
    for i in range(n):
        own = hashes[bounds[i] : bounds[i + 1]]
        if len(own):
            tally = np.unique(own, return_counts=True)[1]
            pieces = words.shingle_hashes(own, 5)
            out[i, 14:18] = len(tally) / len(own), tally.max() / len(own), (own[1:] == own[:-1]).mean() if len(own) > 1 else 0, len(np.unique(pieces)) / len(pieces)
    out[:, 18] = np.log1p(count / (shares[3] + 1))
    out[:, 19] = _sums(after, offsets) / some
    return out


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of about ``_CHUNK`` bytes, one text at least."""
    sizes = np.diff(words.utf8(texts)[1])
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > _CHUNK:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield texts.slice(start)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    return np.concatenate([_features(part) for part in _pieces(texts)]) if len(texts) else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges by feature, a table by feature, and tables of pairs over coarser bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    start: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int, penalty: float, least: float) -> np.ndarray:
    """Values by bin of a tree with at most ``leaves`` leaves that splits the bins' order."""
    g, w = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + penalty)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            cuts = np.arange(a + 1, b)
            cuts = cuts[(w[cuts] - w[a] >= least) & (w[b] - w[cuts] >= least)]
            if len(cuts):
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], part, int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    values = np.zeros(len(grad))
    for a, b in parts:
        values[a:b] = (g[b] - g[a]) / (w[b] - w[a] + penalty)
    return values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 250, rate: float = 0.08, leaves: int = 3, n_pairs: int = 8, pair_bins: int = 8,
        pair_rounds: int = 100, penalty: float = 1.0, least: float = 1.0) -> AdditiveModel:
    """Boost single features in turn, then the pairs that still gain most."""
    if not len(y):
        return AdditiveModel([], [], 0.0, [], [], [])
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    coarse = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    if y.min() == y.max():
        return AdditiveModel(edges, coarse, start, [np.zeros(len(e) + 1) for e in edges], [], [])
    fine_of = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    coarse_of = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), start)
    for _ in range(rounds):
        for f, b in enumerate(fine_of):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b, y - p, len(tables[f])), np.bincount(b, p * (1 - p), len(tables[f])), leaves, penalty, least)
            tables[f] += step
            total += step[b]
    p = 1 / (1 + np.exp(-total))

    def cells(f: int, g: int) -> np.ndarray:
        return coarse_of[f] * (len(coarse[g]) + 1) + coarse_of[g]

    def pair_step(cell: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-total))
        grad, weight = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
        return grad / (weight + 4 * penalty), float((grad**2 / (weight + 4 * penalty)).sum())

    ranked = sorted(((pair_step(cells(f, g), (len(coarse[f]) + 1) * (len(coarse[g]) + 1))[1], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
    pairs = [(f, g) for _, f, g in ranked[:n_pairs]]
    shapes = [(len(coarse[f]) + 1, len(coarse[g]) + 1) for f, g in pairs]
    pair_tables = [np.zeros(shape) for shape in shapes]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(pairs):
            cell = cells(f, g)
            step = rate * pair_step(cell, shapes[k][0] * shapes[k][1])[0]
            pair_tables[k] += step.reshape(shapes[k])
            total += step[cell]
    return AdditiveModel(edges, coarse, start, tables, pairs, pair_tables)


def train(documents: DataFrame, labels: DataFrame, limit: int = 20_000, **settings) -> AdditiveModel:
    """Model of ``labels.quality`` from at most ``limit`` label rows outside the held-out fold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    sample = labelled_texts(words.bounded_batches(documents), labels, "quality", limit).mapInArrow(words.giving_back(rows), "x array<double>, label int").toPandas()
    sample = sample.assign(key=[tuple(v) for v in sample["x"]]).sort_values(["key", "label"])
    x = np.array(list(sample["key"]), float).reshape(-1, len(FEATURES))
    return fit(x, sample["label"].to_numpy(float), **settings)


def score(documents: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(text_features(batch.column(2))))], ["doc_id", "held_out", "score"])

    kind = documents.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    scored = words.bounded_batches(documents).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(words.giving_back(rows), shape)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
