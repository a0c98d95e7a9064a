"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into equal segments, few and long at first, then more and shorter. With the segments' means
and deviations the squared distance of two vectors is at least the sum over segments of
``length * ((mean difference)**2 + (deviation difference)**2)``. Given both norms, a lower bound of the distance
is an upper bound of the inner product: ``sum of length * (mean * mean + deviation * deviation)``. Candidates
whose bound is under the query's k-th best score so far go out at the coarsest resolution that tells; the exact
score is computed for those that pass all of them. A bound equal to the k-th best score passes, and bounds are
widened by more than their rounding, so that results are exact.

Queries and candidates are dealt to a grid of cells by row number, each bounded in bytes: a query row goes to
every column of its grid row, a candidate to every row of its grid column. Cells work on their own, and a
cell's best rows of each query meet in a window by query. No cell depends on values, so equal vectors and hot
ids spread evenly.

Components are floor(256 * x) with x as double. Vectors that are null or hold null or non-finite components
take no part; vectors of different lengths are not compared. A query's own rows are all rows of its id; equal
queries (id and vector) are answered once, other vectors of one id each on their own. Repeated candidates are
separate rows; null ids are candidates, last among ties, and never queries. Scores are exact whole numbers;
one that is no long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rentlens.llm.vector_codes import kept
from rentlens.session import stage

SEGMENTS = (4, 16, 32)
SAFE = 1e-9
CELL_BYTES = 32 << 20
LEAST_CELLS = 32  # grid columns on small tables, for parallel work
QUERIES, CANDIDATES = 256, 4096
SEEDS = 4
EXACT = float(1 << 53)


def statistics(whole: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, both times the root of the segment's length."""
    size = whole.shape[1]
    cuts = np.arange(segments) * size // segments
    length = np.diff(np.append(cuts, size))
    mean = np.add.reduceat(whole, cuts, axis=1) / length
    away = whole - np.repeat(mean, length, axis=1)
    deviation = np.sqrt(np.add.reduceat(away * away, cuts, axis=1) / length)
    return np.hstack([mean, deviation]) * np.sqrt(np.tile(length, 2))


class Candidates:
    """A block of candidates with its statistics at every resolution."""

    def __init__(self, ids: np.ndarray, unknown: np.ndarray, whole: np.ndarray, levels: list[int]):
        self.ids, self.unknown, self.whole = ids, unknown, whole
        self.norms = np.sqrt((whole * whole).sum(1))
        self.levels = [statistics(whole, s) for s in levels]

    def scores(self, rows: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """Exact inner products of some rows with a query, Python integers where doubles would round."""
        if not len(rows):
            return np.zeros(0, np.int64)
        if norm * self.norms[rows].max() < EXACT:
            return (self.whole[rows] @ query).astype(np.int64)
        whole = [[int(x) for x in row] for row in self.whole[rows]]
        other = [int(x) for x in query]
        return np.array([sum(a * b for a, b in zip(row, other)) for row in whole], object)


def _best(scores: np.ndarray, unknown: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], unknown[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, unknown, -scores))[:k]


def top_of_block(block: Candidates, queries: np.ndarray, query_ids: np.ndarray, levels: list[int], k: int, found: list[tuple]) -> None:
    """Better ``found`` (scores, unknown, ids; best first) of each query by a block of candidates."""
    norms = np.sqrt((queries * queries).sum(1))
    stats = [statistics(queries, s) for s in levels]
    coarse = stats[0] @ block.levels[0].T if levels else np.full((len(queries), len(block.ids)), np.inf)
    for i, query in enumerate(queries):
        scores, unknown, ids = found[i]
        slack = SAFE * norms[i] * block.norms
        rows = np.flatnonzero(block.unknown | (block.ids != query_ids[i]))
        least = scores[-1] if len(scores) == k else None
        for level in range(len(levels)):
            bound = (block.levels[level][rows] @ stats[level][i] if level else coarse[i, rows]) + slack[rows]
            if len(rows) > SEEDS * k:  # rows of the largest bounds raise the k-th best score before the rest is asked
                seeds = rows[np.argpartition(-bound, SEEDS * k)[: SEEDS * k]]
                reached = sorted([*scores, *block.scores(seeds, query, norms[i])], reverse=True)[k - 1]
                least = reached if least is None else max(least, reached)
            if least is not None:
                rows = rows[~(bound < float(least) - SAFE * abs(float(least)))]
        exact = block.scores(rows, query, norms[i])
        scores, unknown, ids = np.append(scores, exact), np.append(unknown, block.unknown[rows]), np.append(ids, block.ids[rows])
        order = _best(scores, unknown, ids, k)
        found[i] = scores[order], unknown[order], ids[order]


def _rows(table: pa.Table, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors of each length in a table."""
    column = table.column(vector).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
        yield at, np.floor(256 * values).reshape(len(at), size)


def _cell(k: int):
    def search(asked: pa.Table, offered: pa.Table) -> pa.Table:
        offers = {whole.shape[1]: (at, whole) for at, whole in _rows(offered, "vector")} if len(offered) else {}
        ids = offered.column("vec_id")
        unknown = ids.is_null().to_numpy() if len(offered) else np.zeros(0, bool)
        ids = ids.fill_null(0).to_numpy()
        number, query_ids = asked.column("query").to_numpy(), asked.column("vec_id").to_numpy()
        out = []
        for at, whole in _rows(asked, "vector") if len(asked) else ():
            size = whole.shape[1]
            levels = [s for s in SEGMENTS if s < size]
            places, vectors = offers.get(size, (np.zeros(0, np.int64), np.zeros((0, size))))
            for q in range(0, len(at), QUERIES):
                mine = at[q : q + QUERIES]
                found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(mine)
                for c in range(0, len(places), CANDIDATES):
                    these = places[c : c + CANDIDATES]
                    block = Candidates(ids[these], unknown[these], vectors[c : c + CANDIDATES], levels)
                    top_of_block(block, whole[q : q + QUERIES], query_ids[mine], levels, k, found)
                for row, (scores, none, near) in zip(mine, found):
                    out.append((np.full(len(near), number[row]), np.full(len(near), query_ids[row]), near, none, scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        near = pa.array(columns[2].astype(np.int64), mask=columns[3].astype(bool))
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), near, pa.array(columns[4].tolist(), pa.int64())], ["query", "query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", cell_bytes: int = CELL_BYTES, least_cells: int = LEAST_CELLS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the k best other vectors of each query.

    ``queries`` is a condition on ``vec_id``; ``cell_bytes`` bounds the vectors of either side that a task holds.
    """
    rows = kept(vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")), "vector")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "search-rows")
    asked = rows.where(queries & F.col("vec_id").isNotNull()).select("vec_id", "vector").distinct()
    asked = stage(asked.withColumn("query", F.monotonically_increasing_id()), "search-queries")
    size = F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))
    deep, wide = (1 + table.agg(size).first()[0] // cell_bytes for table in (asked, rows))
    wide = max(wide, least_cells)
    # both sides need the cell numbers in one type: an int and a long of the same value hash to different partitions
    grid = lambda numbers, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(numbers)
    left = asked.select("query", "vec_id", "vector", F.pmod(F.xxhash64("query"), F.lit(deep)).alias("r"), grid("c", wide))
    right = rows.select("vec_id", "vector", F.pmod(F.xxhash64("row"), F.lit(wide)).alias("c"), grid("r", deep))
    cells = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(_cell(k), "query long, query_id long, vec_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
