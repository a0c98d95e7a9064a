"""Extremely randomised trees: at each node every feature draws one threshold between the node's bounds.

The best of these random splits is taken. A draw depends on seed, tree, node and feature alone, through a
hash, so that tasks agree on it without messages and a tree does not depend on how its growth is shared out.

Nodes of more than ``_LOCAL_ROWS`` rows are grown level by level over all rows: one aggregate gives the bounds
of every (tree, node, feature), a second the rows and sums left of the drawn thresholds. The rows of a smaller
node come together in one task, which grows the rest of that subtree. A table that is small as a whole goes
to a number of tasks, each of which grows a share of the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.operators.trees import Trees, TreeSumModel, matrix
from rentlens.session import stage

_LOCAL_ROWS = 50_000
_TREES_AT_ONCE = 16
_SHARES = 64
_NODES = "tree long, key long, feature int, number double, gain double"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = np.asarray(h, np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def root_key(seed: int, tree: np.ndarray) -> np.ndarray:
    """Key of the first node of a tree."""
    with np.errstate(over="ignore"):
        return _mix(_mix(np.uint64(seed % (1 << 64)) + _ODD) + np.asarray(tree, np.uint64) * _ODD)


def child_key(key: np.ndarray, side: int) -> np.ndarray:
    """Key of the left (0) or right (1) child."""
    with np.errstate(over="ignore"):
        return _mix(np.asarray(key, np.uint64) * np.uint64(2) + np.uint64(1 + side) * _ODD)


def draws(key: np.ndarray, width: int) -> np.ndarray:
    """A number from 0 up to 1 for each feature of each node."""
    with np.errstate(over="ignore"):
        mixed = _mix(np.asarray(key, np.uint64)[..., None] ^ _mix(np.arange(1, width + 1, dtype=np.uint64) * _ODD))
    return (mixed >> np.uint64(11)).astype(float) / float(1 << 53)


def _subset(key: np.ndarray, width: int, features: int) -> np.ndarray:
    """Whether a node may split on each feature: those of the smallest second draws."""
    if features >= width:
        return np.ones((*np.shape(key), width), bool)
    order = draws(_mix(np.asarray(key, np.uint64) + _ODD), width).argsort(-1, kind="stable").argsort(-1)
    return order < features


def thresholds(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The drawn threshold of each feature; rows up to it go left, so it stays under the upper bound."""
    cut = low + draws(key, low.shape[-1]) * (high - low)
    return np.where(cut >= high, low, cut)


def _chosen(key, low, high, n, total, left_n, left_total, least, features):
    """Feature and gain of the best drawn split of each node; feature -1 where there is none."""
    right_n, right_total = n[:, None] - left_n, total[:, None] - left_total
    ok = (high > low) & (left_n >= least) & (right_n >= least) & _subset(key, low.shape[1], features)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_total**2 / left_n + right_total**2 / right_n - (total**2 / n)[:, None]
    gain = np.where(ok, gain, -np.inf)
    best = gain.argmax(1)  # the first of equal ones
    top = gain[np.arange(len(best)), best]
    return np.where(np.isfinite(top), best, -1), np.where(np.isfinite(top), np.maximum(top, 0), 0.0)


def subtree(x: np.ndarray, y: np.ndarray, key: int, depth: int, limits: tuple) -> list[tuple]:
    """``key, feature, number, gain`` of all nodes below and with ``key``, grown on its rows."""
    least, split, deepest, features = limits
    out, open_nodes = [], [(np.uint64(key), depth, np.arange(len(y)))]
    while open_nodes:
        key, depth, rows = open_nodes.pop()
        mine, target = x[rows], y[rows]
        if len(rows) >= max(split, 2 * least) and (not deepest or depth < deepest) and target.min() < target.max():
            low, high = mine.min(0), mine.max(0)
            cut = thresholds(key, low, high)
            left = mine <= cut
            n, total = np.array([len(rows)]), np.array([target.sum()])
            feature, gain = _chosen(np.array([key]), low[None], high[None], n, total, left.sum(0)[None].astype(float), (target @ left)[None], least, features)
            f = int(feature[0])
            if f >= 0:
                out.append((int(np.int64(key.view(np.int64))), f, float(cut[f]), float(gain[0])))
                open_nodes.append((child_key(key, 0)[()], depth + 1, rows[left[:, f]]))
                open_nodes.append((child_key(key, 1)[()], depth + 1, rows[~left[:, f]]))
                continue
        out.append((int(np.int64(key.view(np.int64))), -1, float(target.mean()), 0.0))
    return out


def _node_table(tree: int, nodes: list[tuple]) -> pa.Table:
    keys, features, numbers, gains = zip(*nodes)
    return pa.table([pa.array([tree] * len(nodes), pa.int64()), pa.array(keys, pa.int64()), pa.array(features, pa.int32()), pa.array(numbers, pa.float64()), pa.array(gains, pa.float64())],
                    ["tree", "key", "feature", "number", "gain"])


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("x").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return matrix(column), table.column("y").to_numpy()


def _shared_out(rows: DataFrame, seed: int, trees: int, limits: tuple) -> DataFrame:
    """All trees of a table that one task can hold, each task a share of them."""
    shares = min(trees, _SHARES)

    def grow(group: pa.Table) -> pa.Table:
        x, y = _rows_of(group)
        share = group.column("share")[0].as_py()
        order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows arrive
        x, y = x[order], y[order]
        return pa.concat_tables([_node_table(t, subtree(x, y, root_key(seed, t)[()], 0, limits)) for t in range(share, trees, shares)])

    copies = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return copies.groupBy("share").applyInArrow(grow, _NODES)


class _Frontier:
    """Some trees grown so far: nodes by (tree, key), with the large ones that the next level splits."""

    def __init__(self, seed: int, trees: list[int], count: int, total: float):
        self.trees = trees
        keys = root_key(seed, np.array(trees))
        self.split: dict[tuple[int, int], tuple[int, float, float]] = {}
        self.leaf: dict[tuple[int, int], float] = {}
        self.small: dict[tuple[int, int], int] = {}  # to their depth
        self.large = [(t, int(k), count, total, 0) for t, k in zip(trees, keys)]
        self.roots = {t: int(k) for t, k in zip(trees, keys)}

    def route(self):
        """Function from a tree and rows to the row's node among ``names``, or -1."""
        names = [(t, k) for t, k, *_ in self.large] + sorted(self.small)
        place = {name: i for i, name in enumerate(names)}
        split, roots = dict(self.split), dict(self.roots)

        def nodes(tree: int, x: np.ndarray) -> np.ndarray:
            out, todo = np.full(len(x), -1), [(roots[tree], np.arange(len(x)))]
            while todo:
                key, rows = todo.pop()
                if not len(rows):
                    continue
                if (tree, key) in split:
                    f, cut, _ = split[tree, key]
                    right = x[rows, f] > cut
                    todo += [(int(child_key(np.uint64(key), 0)), rows[~right]), (int(child_key(np.uint64(key), 1)), rows[right])]
                elif (tree, key) in place:
                    out[rows] = place[tree, key]
            return out

        return names, nodes


def _by_node(place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings the rows of a node together, the nodes met, and where each begins."""
    order = np.argsort(place, kind="stable")
    order = order[np.searchsorted(place[order], 0) :]
    met, begins = np.unique(place[order], return_index=True)
    return order, met, begins


def _bounds(rows: DataFrame, frontier: _Frontier, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each feature in each large node."""
    names, nodes = frontier.route()
    size, trees = len(frontier.large), frontier.trees

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((size, width), np.inf), np.full((size, width), -np.inf)
        for batch in batches:
            x = matrix(batch.column(0))
            for tree in trees if len(x) else ():
                place = nodes(tree, x)
                order, met, begins = _by_node(np.where(place < size, place, -1), size)
                if len(met):
                    low[met] = np.minimum(low[met], np.minimum.reduceat(x[order], begins))
                    high[met] = np.maximum(high[met], np.maximum.reduceat(x[order], begins))
        met = np.flatnonzero(np.isfinite(low[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(low[met, j]) for j in range(width)], *[pa.array(high[met, j]) for j in range(width)]],
                                         ["node", *[f"l{j}" for j in range(width)], *[f"h{j}" for j in range(width)]])

    shape = "node long" + "".join(f", {c}{j} double" for c in "lh" for j in range(width))
    found = rows.mapInArrow(measured, shape).groupBy("node").agg(*[F.min(f"l{j}").alias(f"l{j}") for j in range(width)], *[F.max(f"h{j}").alias(f"h{j}") for j in range(width)]).toArrow()
    at = found.column("node").to_numpy()
    low, high = np.zeros((size, width)), np.zeros((size, width))
    for j in range(width):
        low[at, j], high[at, j] = found.column(f"l{j}").to_numpy(), found.column(f"h{j}").to_numpy()
    return low, high


def _lefts(rows: DataFrame, frontier: _Frontier, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of the target up to the drawn threshold of each feature in each large node."""
    names, nodes = frontier.route()
    (size, width), trees = cuts.shape, frontier.trees

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((size, width)), np.zeros((size, width))
        for batch in batches:
            x, y = matrix(batch.column(0)), batch.column(1).to_numpy()
            for tree in trees if len(x) else ():
                place = nodes(tree, x)
                order, met, begins = _by_node(np.where(place < size, place, -1), size)
                if len(met):
                    left = x[order] <= cuts[place[order]]
                    n[met] += np.add.reduceat(left.astype(float), begins)
                    total[met] += np.add.reduceat(left * y[order, None], begins)
        met = np.arange(size)
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(n[:, j]) for j in range(width)], *[pa.array(total[:, j]) for j in range(width)]],
                                         ["node", *[f"n{j}" for j in range(width)], *[f"s{j}" for j in range(width)]])

    names = [f"{c}{j}" for c in "ns" for j in range(width)]
    found = rows.mapInArrow(measured, "node long, " + ", ".join(f"{c} double" for c in names)).groupBy("node").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    at = found.column("node").to_numpy()
    n, total = np.zeros((size, width)), np.zeros((size, width))
    for j in range(width):
        n[at, j], total[at, j] = found.column(f"n{j}").to_numpy(), found.column(f"s{j}").to_numpy()
    return n, total


def _by_levels(rows: DataFrame, seed: int, trees: list[int], count: int, total: float, width: int, limits: tuple, local: int) -> DataFrame:
    """Some trees of a large table: levels over all rows down to small nodes, whose subtrees tasks grow."""
    least, split, deepest, features = limits
    frontier = _Frontier(seed, trees, count, total)
    while frontier.large:
        low, high = _bounds(rows, frontier, width)
        keys = np.array([k for _, k, *_ in frontier.large], np.uint64)
        cuts = thresholds(keys, low, high)
        left_n, left_total = _lefts(rows, frontier, cuts)
        n, totals = np.array([v[2] for v in frontier.large], float), np.array([v[3] for v in frontier.large])
        feature, gain = _chosen(keys, low, high, n, totals, left_n, left_total, least, features)
        following = []
        for i, (tree, key, rows_in, sum_in, depth) in enumerate(frontier.large):
            f = int(feature[i])
            if f < 0 or (deepest and depth >= deepest):
                frontier.leaf[tree, key] = sum_in / rows_in
                continue
            frontier.split[tree, key] = (f, float(cuts[i, f]), float(gain[i]))
            sides = ((left_n[i, f], left_total[i, f]), (rows_in - left_n[i, f], sum_in - left_total[i, f]))
            for side, (m, s) in enumerate(sides):
                child = int(child_key(np.uint64(key), side))
                if m <= local:
                    frontier.small[tree, child] = depth + 1
                else:
                    following.append((tree, child, int(m), float(s), depth + 1))
        frontier.large = following
    names, nodes = frontier.route()
    depths = dict(frontier.small)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            for tree in trees if len(x) else ():
                place = nodes(tree, x)
                at = np.flatnonzero(place >= 0)
                keys = np.array([names[p][1] for p in place[at]], np.uint64).view(np.int64)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree)), pa.array(keys), part.column(0), part.column(1)], ["tree", "key", "x", "y"])

    def grow(group: pa.Table) -> pa.Table:
        x, y = _rows_of(group)
        order = np.lexsort((*x.T, y))
        tree, key = group.column("tree")[0].as_py(), int(np.int64(group.column("key")[0].as_py()).view(np.uint64))
        return _node_table(tree, subtree(x[order], y[order], key, depths[tree, key], limits))

    below = rows.mapInArrow(dealt, "tree long, key long, x array<double>, y double").groupBy("tree", "key").applyInArrow(grow, _NODES)
    signed = lambda key: int(np.uint64(key).view(np.int64))
    above = [(t, signed(k), f, cut, gain) for (t, k), (f, cut, gain) in frontier.split.items()] + [(t, signed(k), -1, v, 0.0) for (t, k), v in frontier.leaf.items()]
    return below.unionByName(rows.sparkSession.createDataFrame(above, _NODES)) if above else below


def assembled(nodes: pa.Table, seed: int, trees: int) -> Trees:
    """Node rows of all trees as flat arrays, the children of a node side by side."""
    tree, key = nodes.column("tree").to_numpy(), nodes.column("key").to_numpy().view(np.uint64)
    feature, number, gain = (nodes.column(c).to_numpy() for c in ("feature", "number", "gain"))
    parts_feature, parts_number, parts_left, parts_gain, roots, shift = [], [], [], [], [], 0
    order = np.lexsort((key, tree))
    cuts = np.searchsorted(tree[order], np.arange(trees + 1))
    for t in range(trees):
        rows = order[cuts[t] : cuts[t + 1]]
        sorted_keys = key[rows]
        find = lambda k: rows[np.searchsorted(sorted_keys, k)]
        level, placed, left = find(root_key(seed, np.array([t]))), [], []
        at = shift + 1
        roots.append(shift)
        while len(level):
            inner = feature[level] >= 0
            placed.append(level)
            lefts = np.zeros(len(level), np.int64)
            lefts[inner] = at + 2 * np.arange(inner.sum())
            left.append(lefts)
            at += 2 * int(inner.sum())
            keys = key[level[inner]]
            children = np.empty(2 * len(keys), np.uint64)
            children[0::2], children[1::2] = child_key(keys, 0), child_key(keys, 1)
            level = find(children)
        chosen = np.concatenate(placed)
        parts_feature.append(feature[chosen])
        parts_number.append(number[chosen])
        parts_gain.append(gain[chosen])
        parts_left.append(np.concatenate(left))
        shift = at
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return Trees(np.array(roots, np.int64), join(parts_feature, np.int32), join(parts_number, float), join(parts_left, np.int64), join(parts_gain, float))


class ExtraTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of ``numTrees`` extremely randomised trees, each grown on all rows.

    ``maxDepth`` 0 sets no limit; ``featureSubsetStrategy`` is ``all``, ``sqrt``, ``log2`` or a share. Trees
    grow until their leaves are pure unless a limit stops them, so a forest without limits grows with its rows.
    """

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth, 0 for none", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "least rows of a node that is split", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features a node may split on", TypeConverters.toString)
    localRows = Param(Params._dummy(), "localRows", "rows of a node that one task may hold", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=500, maxDepth=0, minInstancesPerNode=1,
                 minSplit=2, featureSubsetStrategy="all", seed=42, localRows=_LOCAL_ROWS):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, numTrees=numTrees, maxDepth=maxDepth,
                  minInstancesPerNode=minInstancesPerNode, minSplit=minSplit, featureSubsetStrategy=featureSubsetStrategy, seed=seed, localRows=localRows)

    def setParams(self, **values):
        return self._set(**values)

    def features(self, width: int) -> int:
        """Number of features a node may split on."""
        rule = self.getOrDefault(self.featureSubsetStrategy)
        named = {"all": width, "sqrt": int(math.sqrt(width)), "log2": int(math.log2(max(width, 1)))}
        return max(1, named[rule] if rule in named else int(float(rule) * width))

    def _fit(self, dataset: DataFrame) -> TreeSumModel:
        get, seed, trees = self.getOrDefault, self.getSeed(), self.getOrDefault(self.numTrees)
        rows = stage(dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")), "trees")
        count, total, width = rows.agg(F.count("*"), F.sum("y"), F.max(F.size("x"))).first()
        if not count:
            blank = Trees(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
            return self._copyValues(TreeSumModel(blank, 0.0, 1.0, 0))
        limits = (get(self.minInstancesPerNode), get(self.minSplit), get(self.maxDepth), self.features(width))
        local = get(self.localRows)
        if count <= local:
            nodes = stage(_shared_out(rows, seed, trees, limits), "tree-nodes").toArrow()
        else:
            parts = [stage(_by_levels(rows, seed, list(range(a, min(a + _TREES_AT_ONCE, trees))), count, total, width, limits, local), "tree-nodes").toArrow()
                     for a in range(0, trees, _TREES_AT_ONCE)]
            nodes = pa.concat_tables(parts)
        return self._copyValues(TreeSumModel(assembled(nodes, seed, trees), 0.0, 1.0 / trees, width))
