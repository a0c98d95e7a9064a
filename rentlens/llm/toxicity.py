"""Toxicity: non-negative positive-unlabelled learning of a linear model over word features.

Confirmed toxic texts are the positives, a sample of all texts is unlabelled. The risk of the negative
class is the unlabelled risk less the share that positives have in it; where that estimate falls
below zero, the step climbs it again instead of descending. Features are words and the beginnings of words,
present or absent, so that inflected forms of one stem share evidence.

The sample is bounded by ``limit`` positives and ``unlabelled`` texts, the vocabulary by ``vocabulary``
features; only the model's few features reach the scoring tasks. Null counts as empty. Without positives
every score is 0. Repeated documents are scored each.
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
from rentlens.llm.labelled import held_out, sampled_ids
from rentlens.llm.quality import _pieces
from rentlens.session import stage

PREFIXES = (4, 5, 6, 7, 8)
LEVELS = 3  # present, repeated, at least one word in ``DENSE``
DENSE = 100
_BITS = 22


def _present(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slice: words of each text, then features and the texts that have them, repeated as the words are."""
    for part in _pieces(texts):
        data, offsets = words.utf8(part)
        hashes, owners, heads = words.word_hashes(data, offsets, PREFIXES)
        found = [(hashes, owners)] + [(h[h != 0], owners[h != 0]) for h in heads]
        yield np.bincount(owners, minlength=len(part)), np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found])


def _levels(size: np.ndarray, known: np.ndarray, features: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and the places ``feature * LEVELS + level`` they have, of the features in ``known``, sorted by text."""
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    hit = known[at] == features
    pair, times = np.unique(owners[hit] * len(known) + at[hit], return_counts=True)
    text, place = pair // len(known), pair % len(known) * LEVELS
    more, dense = times > 1, times * DENSE >= size[text]
    text, place = np.concatenate([text, text[more], text[dense]]), np.concatenate([place, place[more] + 1, place[dense] + 2])
    order = np.argsort(text, kind="stable")
    return text[order], place[order]


@dataclass(frozen=True)
class LinearModel:
    features: np.ndarray  # sorted
    weights: np.ndarray  # ``LEVELS`` for each feature
    start: float

    def slots(self) -> np.ndarray:
        """Table of the leading bits that any feature has."""
        slots = np.zeros(1 << _BITS, bool)
        slots[self.features >> np.uint64(64 - _BITS)] = True
        return slots

    def scores(self, texts: pa.Array, slots: np.ndarray) -> np.ndarray:
        out = []
        for size, features, owners in _present(texts):
            total = np.full(len(size), self.start)
            near = np.flatnonzero(slots[features >> np.uint64(64 - _BITS)])
            if len(near):
                text, place = _levels(size, self.features, features[near], owners[near])
                total += np.bincount(text, self.weights[place], len(size))
            out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def _fit(doc: np.ndarray, feature: np.ndarray, positive: np.ndarray, size: int, prior: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights by the non-negative risk estimator with logistic loss and Adam steps over the sample."""
    share = np.where(positive, prior / positive.sum(), 1 / max((~positive).sum(), 1))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[feature], len(positive)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_negative = np.logaddexp(0, z)
        negative_risk = (share * loss_negative)[~positive].sum() - (share * loss_negative)[positive].sum()
        as_negative = np.where(positive, -share, share) * p
        slope = np.where(positive, share * (p - 1), 0) + as_negative if negative_risk >= 0 else -as_negative
        grad = np.append(np.bincount(feature, slope[doc], size) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, limit: int = 4000, unlabelled: int = 8000, vocabulary: int = 20_000, prior: float | None = None,
          steps: int = 400, rate: float = 0.05, decay: float = 2e-5, least_z: float = 4.0) -> LinearModel:
    """Fit on confirmed toxic rows and unlabelled text, none of the held-out fold.

    ``prior`` is the share of toxic texts; by default that of the label rows outside the fold.
    """
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out())
    if prior is None:
        prior = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    empty = LinearModel(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    if not prior:
        return empty
    prior = min(max(float(prior), 1e-4), 0.9)
    chosen = sampled_ids(marked.where("toxic = 1").select("doc_id"), limit).withColumn("positive", F.lit(True)).unionByName(
        sampled_ids(documents.select("doc_id"), unlabelled).withColumn("positive", F.lit(False)))
    sample = stage(words.bounded_batches(documents).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("positive", F.lower("text").alias("text")), "toxic-sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, features, owners in _present(batch.column(0)):
                order = np.lexsort((owners, features))
                features, owners = features[order], owners[order]
                new = np.ones(len(features), bool)
                new[1:] = (features[1:] != features[:-1]) | (owners[1:] != owners[:-1])
                kept, count = np.unique(features[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(count.astype(np.int64))], ["feature", "n"])

    frequent = sample.where("positive").select("text").mapInArrow(words.giving_back(tally), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where("n >= 3")
    kept = np.sort(np.array([r[0] for r in frequent.orderBy(F.desc("n"), "feature").limit(vocabulary).collect()], np.int64).view(np.uint64))
    if not len(kept):
        return empty

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for size, features, owners in _present(batch.column(1)):
                text, place = _levels(size, kept, features, owners)
                cuts = np.searchsorted(text, np.arange(len(size) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(size)), lists], ["positive", "features"])
                row += len(size)

    # rows of the bounded sample, each with at most ``LEVELS * vocabulary`` features
    rows = sample.select("positive", "text").mapInArrow(words.giving_back(indexed), "positive boolean, features array<int>").toArrow().combine_chunks()
    positive = rows.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    if not positive.any() or positive.all():
        return empty
    lists = rows.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    feature = lists.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(positive)), np.diff(lists.offsets.to_numpy()))
    places = len(kept) * LEVELS
    in_p = np.bincount(feature, positive[doc], places) / positive.sum()
    in_u = np.bincount(feature, ~positive[doc], places) / (~positive).sum()
    z = (in_p - in_u) / np.sqrt((in_p * (1 - in_p) + 1e-3) / positive.sum() + (in_u * (1 - in_u) + 1e-3) / (~positive).sum())
    use = np.flatnonzero(np.abs(z) >= least_z)
    if not len(use):
        return empty
    column = np.full(places, -1)
    column[use] = np.arange(len(use))
    live = column[feature] >= 0
    w, b = _fit(doc[live], column[feature[live]], positive, len(use), prior, steps, rate, decay)
    weights = np.zeros(places)
    weights[use] = w
    chosen = np.unique(use // LEVELS)
    return LinearModel(kept[chosen], weights.reshape(-1, LEVELS)[chosen].ravel(), b)


def score(documents: DataFrame, model: LinearModel, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """All columns of the documents, or those in ``keep``, then ``toxic_score`` and ``toxic_predicted`` of the whole text.

    Columns that already have one of these two names are replaced.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in batches:
            scores = pa.array(model.scores(batch.column(batch.num_columns - 1), slots))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "toxic_score"])

    names = [c for c in (documents.columns if keep is None else keep) if c not in ("toxic_score", "toxic_predicted")]
    plain = words.bounded_batches(documents).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.lower(F.col("text")).alias("lowered"))
    shape = T.StructType([T.StructField(f"c{i}", documents.schema[c].dataType) for i, c in enumerate(names)] + [T.StructField("toxic_score", T.DoubleType())])
    scored = plain.mapInArrow(words.giving_back(rows), shape)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "toxic_score", (F.col("toxic_score") >= threshold).cast("int").alias("toxic_predicted"))
