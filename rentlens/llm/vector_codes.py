"""Product codes of vectors, each part's nearest codebook entry found by a GNAT over the entries.

A geometric near-neighbour access tree keeps a few split points a node, each other entry under its nearest
split point, and for every pair of split point and child the range of distances between them. A query
measures its distance to the split points; a child whose range the triangle inequality puts farther away than
the best entry so far is left out as a whole. Bounds are rounded to the safe side and a subtree goes only if
it is strictly farther, so that equal distances are still met; distances themselves are whole numbers and the
smaller index wins ties.

Spark passes over the vectors once a round: tasks add up their parts by entry, Spark adds the tasks' sums, and
only the entries (``entries`` vectors at most) come to the driver and go to the tasks again.

Vectors that are null or hold null or non-finite components are left out. With fewer than ``entries`` kept
vectors the codebooks are smaller; an empty table gives no rows. Rows with equal ids are separate rows, ordered
by their vector where the first ``entries`` are chosen; null ids come last. All vectors need one length that
``parts`` divides, and components under 2**26 in magnitude: anything else is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.operators.lookup import lookup_join
from rentlens.session import stage

SAFE = 1e-9
ROWS = 8192
LARGEST = 1 << 34


class Gnat:
    """Tree over the entries of one part, searched for many queries at a time."""

    def __init__(self, points: np.ndarray, arity: int = 8, leaf: int = 8):
        self.points, self.arity, self.leaf = points.astype(np.int64), arity, leaf
        self.root = self._node(np.arange(len(points)))

    def _squares(self, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(entries)), np.int64)
        for d in range(rows.shape[1]):
            out += np.square(rows[:, d, None] - self.points[entries, d])
        return out

    def _node(self, entries: np.ndarray) -> dict | None:
        if not len(entries):
            return None
        if len(entries) <= self.leaf:
            return {"splits": entries, "children": []}
        # split points far from each other: each next one is the farthest from those before
        chosen, far = [0], self._squares(self.points[entries], entries[:1])[:, 0]
        while len(chosen) < self.arity and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self._squares(self.points[entries], entries[chosen[-1:]])[:, 0])
        splits = entries[np.sort(chosen)]
        rest = np.delete(entries, chosen)
        apart = self._squares(self.points[rest], splits)
        nearest, roots = apart.argmin(1), np.sqrt(apart.astype(float))
        children = []
        for j in range(len(splits)):
            mine = nearest == j
            if mine.any():
                low, high = roots[mine].min(0) * (1 - SAFE), roots[mine].max(0) * (1 + SAFE)
                children.append((j, low, high, self._node(rest[mine])))
        return {"splits": splits, "children": children}

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the smaller one of equally near ones, and the squared distance."""
        best, index = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
        self._search(self.root, rows, np.arange(len(rows)), best, index)
        return index, best

    def _search(self, node: dict | None, rows: np.ndarray, at: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if node is None or not len(at):
            return
        squares = self._squares(rows[at], node["splits"])
        first = squares.argmin(1)  # splits ascend, so the first least one has the smallest index
        least, entry = squares[np.arange(len(at)), first], node["splits"][first]
        better = (least < best[at]) | ((least == best[at]) & (entry < index[at]))
        best[at[better]], index[at[better]] = least[better], entry[better]
        if not node["children"]:
            return
        roots = np.sqrt(squares.astype(float))
        under, over = roots * (1 - SAFE), roots * (1 + SAFE)
        gaps = [(first == j, np.maximum(under - high, low - over).max(1), child) for j, low, high, child in node["children"]]
        for own in (True, False):  # each row's nearest child first, which tightens the bound for the others
            for mine, gap, child in gaps:
                asked = mine if own else ~mine
                reached = asked & ~(gap > np.sqrt(best[at].astype(float)) * (1 + SAFE))
                self._search(child, rows, at[reached], best, index)


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vectors.where(F.col(vector).isNotNull() & F.forall(vector, fine))


def _whole(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """The vectors as whole numbers floor(256 * x), cut into parts: rows, parts, width."""
    sizes = np.asarray(column.value_lengths())
    if (sizes != parts * width).any():
        raise ValueError(f"vectors need {parts * width} components as the first one has")
    values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError("components of 2**26 or more are too large for whole-number distances")
    return values.astype(np.int64).reshape(len(sizes), parts, width)


def _assigned(trees: list[Gnat], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, errors = np.zeros(whole.shape[:2], np.int64), np.zeros(len(whole), np.int64)
    for p, tree in enumerate(trees):
        for at in range(0, len(whole), ROWS):
            index, squares = tree.nearest(whole[at : at + ROWS, p])
            codes[at : at + ROWS, p] = index
            errors[at : at + ROWS] += squares
    return codes, errors


def _updated(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after one round: entries become the floored means of their parts, unused ones stay."""
    parts, entries, width = codebooks.shape
    names = [f"s{d}" for d in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codebooks]
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            whole = _whole(batch.column(0), parts, width)
            for at in range(0, len(whole), ROWS):
                codes, _ = _assigned(trees, whole[at : at + ROWS])
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    for d in range(width):  # sums of at most 8,192 numbers under 2**34 are exact as doubles
                        totals[p, :, d] += np.bincount(codes[:, p], whole[at : at + ROWS, p, d], entries).astype(np.int64)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), *[pa.array(totals[p, e, d]) for d in range(width)]], ["part", "entry", "n", *names])

    shape = "part long, entry long, n long" + "".join(f", {s} long" for s in names)
    rows = vectors.mapInArrow(sums, shape).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
    new = codebooks.copy()
    for row in rows.collect():  # at most parts * entries rows
        new[row["part"], row["entry"]] = [row[s] // row["n"] for s in names]
    return new


def trained(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Codebooks of shape parts, entries, width, started from the vectors of the smallest ids."""
    rows = kept(vectors, vector).select(F.col(f"`{key}`").alias("k"), F.col(vector).alias("v"))
    start = [r["v"] for r in rows.where("v is not null").orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()]
    if not start:
        return np.zeros((parts, 0, 0), np.int64)
    if len(start[0]) % parts:
        raise ValueError(f"{len(start[0])} components cannot be cut into {parts} equal parts")
    width = len(start[0]) // parts
    codebooks = np.ascontiguousarray(_whole(pa.array(start, pa.list_(pa.float64())), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        codebooks = _updated(rows.select("v"), codebooks)
    return codebooks


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, codebooks: np.ndarray, keep: tuple[str, ...] = ("vec_id", "label"), vector: str = "embedding") -> DataFrame:
    """The ``keep`` columns of every kept vector, ``code`` (two hex digits a part) and ``error`` (summed squared distances)."""
    parts, entries, width = codebooks.shape
    fields = [vectors.schema[c] for c in keep]
    rows = kept(vectors, vector).select(*[F.col(f"`{c}`") for c in keep], F.col(vector).alias("vector_to_code"))
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["code string, error long"])
    if not entries:
        return rows.select(*keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codebooks]
        for batch in batches:
            found, errors = _assigned(trees, _whole(batch.column(len(keep)), parts, width))
            text = [row.tobytes().hex() for row in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(text, pa.string()), pa.array(errors)], [*keep, "code", "error"])

    return rows.mapInArrow(codes, shape)


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, key: str = "vec_id", label: str = "label") -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` (errors of equal labels) and ``codebooks_sha256`` of every kept vector.

    Errors are added up by label before they are shuffled; the sums come back by a join that splits hot labels.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    plain = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), "embedding")
    codebooks = trained(plain, parts, entries, rounds)
    rows = stage(encoded(plain, codebooks), "vector-codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = lookup_join(rows, sums, ["label"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))
