"""Benchmark decontamination: windows of a benchmark item's size, found by SimHash and verified exactly.

A window of as many words as an item is compared through 64-bit SimHash fingerprints of five-word shingles,
weighted by how often they occur. The items' fingerprints are indexed by four blocks of 16 bits: two
fingerprints within ``radius`` differ in at most ``radius // 4`` bits in some block, so probing all block
values that near finds every fingerprint within the radius. Candidates count if the weighted Jaccard
similarity of their shingles, sum of smaller counts over sum of larger, reaches the threshold.

Windows that hold too few shingles of items of their size for the threshold are skipped before fingerprinting; that
drops no window that could match. Texts with fewer words than an item are one window. Items under five
words match by all their words; items without words match nothing. Case does not count.

The benchmark is taken in chunks of at most ``chunk_bytes`` of text, so what tasks hold is bounded; more
chunks are more passes. Null texts count as empty. Repeated documents and items are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm import words
from rentlens.llm.quality import _pieces

SHINGLE = 5
_SLOTS = 22


def fingerprint(shingles: np.ndarray) -> int:
    """Sign of the sum of each bit over all shingles; repeated shingles weigh as often as they occur."""
    bits = (shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return int(((bits.sum(0) * 2 >= len(shingles)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    keys, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(keys)), np.bincount(where[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Items of one chunk: shingles, fingerprints and block tables by item size."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float, radius: int):
        self.ids, self.threshold, self.radius = ids, threshold, radius
        data, offsets = words.utf8(pa.array(texts, pa.string()))
        hashes, owners, _ = words.word_hashes(data, offsets)
        bounds = words.by_text(owners, len(ids))
        self.shingles = [words.shingle_hashes(hashes[bounds[i] : bounds[i + 1]], SHINGLE) for i in range(len(ids))]
        self.sizes: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(bounds).tolist()):
            if n:
                self.sizes.setdefault(n, []).append(i)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self.known >> np.uint64(64 - _SLOTS)] = True
        self.prints = np.array([fingerprint(s) if len(s) else 0 for s in self.shingles], np.uint64)
        masks = [sum(1 << k for k in chosen) for n in range(radius // 4 + 1) for chosen in combinations(range(16), n)]
        self.masks = np.array(masks, np.int64)
        self.by_size = {size: np.unique(np.concatenate([self.shingles[i] for i in items])) for size, items in self.sizes.items()}
        self.blocks = {size: self._tables(np.array(items)) for size, items in self.sizes.items()}

    def _tables(self, items: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block: which values occur, sorted, and the items that have them."""
        out = []
        for k in range(4):
            values = ((self.prints[items] >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(values, kind="stable")
            out.append((values[order], items[order]))
        return out

    def near(self, size: int, found: int) -> np.ndarray:
        """Items of the size within the radius."""
        near = []
        for k, (values, items) in enumerate(self.blocks[size]):
            asked = (found >> (16 * k) & 0xFFFF) ^ self.masks
            left, right = np.searchsorted(values, asked), np.searchsorted(values, asked, side="right")
            near += [items[a:b] for a, b in zip(left[left < right], right[left < right])]
        if not near:
            return np.zeros(0, np.int64)
        items = np.unique(np.concatenate(near))
        return items[np.bitwise_count(self.prints[items] ^ np.uint64(found)) <= self.radius]

    def _seen(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), bool)
        near = np.flatnonzero(self.slots[shingles >> np.uint64(64 - _SLOTS)])
        if len(near):
            at = np.minimum(np.searchsorted(self.known, shingles[near]), len(self.known) - 1)
            out[near] = self.known[at] == shingles[near]
        return out

    def _hits(self, own: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Best window of each item found in one text: similarity, first word, words."""
        best: dict[int, tuple[float, int, int]] = {}
        runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in self.sizes:
            width = min(size, SHINGLE, len(own))
            if width not in runs:
                shingles = words.shingle_hashes(own, width)
                runs[width] = shingles, np.flatnonzero(self._seen(shingles))
            shingles, seen = runs[width]
            whole, span = size - min(size, SHINGLE) + 1, min(size, len(own)) - width + 1
            least = self.threshold / (1 + self.threshold) * (whole + span) - 1e-9
            if len(seen) < least:
                continue
            known = self.by_size[size]
            at = np.minimum(np.searchsorted(known, shingles[seen]), len(known) - 1)
            total = np.zeros(len(shingles) + 1, np.int64)
            total[seen[known[at] == shingles[seen]] + 1] = 1
            np.cumsum(total, out=total)
            for start in np.flatnonzero(total[span:] - total[:-span] >= least).tolist():
                window = shingles[start : start + span]
                for item in self.near(size, fingerprint(window)).tolist():
                    similarity = weighted_jaccard(window, self.shingles[item])
                    if similarity >= self.threshold and (item not in best or similarity > best[item][0]):
                        best[item] = (similarity, start, min(size, len(own)))
        return best

    def search(self, texts: pa.Array) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
        """Texts with hits, by place in the batch."""
        row = 0
        short = min(self.sizes, default=SHINGLE) < SHINGLE
        for part in _pieces(texts):
            data, offsets = words.utf8(part)
            hashes, owners, _ = words.word_hashes(data, offsets)
            bounds = words.by_text(owners, len(part))
            if short or len(hashes) < SHINGLE:
                chosen = range(len(part))
            else:
                seen = self._seen(words.shingle_hashes(hashes, SHINGLE))  # a run over two texts may only add a text
                chosen = np.union1d(owners[np.flatnonzero(seen)], np.flatnonzero(np.diff(bounds) < SHINGLE)).tolist()
            for i in chosen:
                own = hashes[bounds[i] : bounds[i + 1]]
                if len(own) and (hits := self._hits(own)):
                    yield row + i, hits
            row += len(part)


def _chunks(benchmark: DataFrame, threshold: float, radius: int, chunk_bytes: int) -> Iterator[object]:
    """Broadcast indexes over at most about ``chunk_bytes`` of item text each."""
    items = benchmark.select("item_id", F.lower("text").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // chunk_bytes))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], threshold, radius))


def matches(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 20, chunk_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``start_word`` and ``n_words`` of each item's best window in each document."""
    shape = T.StructType([
        T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
        T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()),
    ])
    out = None
    for index in _chunks(benchmark, threshold, radius, chunk_bytes):

        def rows(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, item, *hit) for i, hits in index.value.search(batch.column(1)) for item, hit in hits.items()]
                if found:
                    at, items, similarity, start, size = zip(*found)
                    ids = pa.array([index.value.ids[k] for k in items])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids, *map(pa.array, (similarity, start, size))], shape.names)

        part = words.bounded_batches(documents).select("doc_id", F.lower("text").alias("text")).mapInArrow(words.giving_back(rows), shape)
        out = part if out is None else out.unionByName(part)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 20, chunk_bytes: int = 16 << 20) -> DataFrame:
    """The documents in which no item is found, all their columns unchanged. Nothing shuffles."""
    names = documents.columns
    shape = T.StructType([T.StructField(f"c{i}", documents.schema[c].dataType) for i, c in enumerate(names)])
    for index in _chunks(benchmark, threshold, radius, chunk_bytes):

        def rows(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in index.value.search(batch.column(batch.num_columns - 1))]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], shape.names).filter(pa.array(keep))

        plain = words.bounded_batches(documents).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.lower(F.col("text")).alias("lowered"))
        documents = plain.mapInArrow(words.giving_back(rows), shape).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
    return documents
