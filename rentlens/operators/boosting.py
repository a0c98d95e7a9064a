"""Histogram gradient boosting with trees grown best leaf first.

Features are cut into bins once. A round fits a tree to the residuals: tasks add up rows and gradients of
their rows by (node, feature, bin), the histograms are dealt by node and feature, added up there, and give the
best split of every node. Leaves are split in order of their gain until the leaf limit, and a leaf's place in
that order is not known before its own histogram is. So one pass takes the histograms of the children of all
leaves that may still be split; the order is then followed as far as it is known. The tree is the one that
splitting leaf by leaf gives, with about as many passes as it is deep.

Rows carry their prediction; it is written anew every ``_CARRY`` rounds, between which tasks add the few trees
since. The driver sees one best split a node, never a histogram. The loss is the squared error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.operators import sketches as K
from rentlens.operators.trees import Trees, TreeSumModel, joined, matrix
from rentlens.session import stage

_CARRY = 10
_DISTINCT_ERROR = 0.05


def bin_edges(rows: DataFrame, width: int, bins: int, accuracy: float) -> list[np.ndarray]:
    """Upper bounds of all bins but the last for each feature of the array column ``x``.

    A feature of few values has a bin for each; others are cut at even ranks, found within ``accuracy``.
    """
    counts = rows.agg(*[F.approx_count_distinct(F.col("x")[j], _DISTINCT_ERROR / 2).alias(f"d{j}") for j in range(width)]).first()
    few = [j for j in range(width) if counts[j] <= bins * (1 + _DISTINCT_ERROR)]
    k = K.sketch_size(accuracy)
    found = rows.agg(*[(F.collect_set(F.col("x")[j]) if j in few else F.kll_sketch_agg_double(F.col("x")[j], F.lit(k))).alias(f"c{j}") for j in range(width)])
    ranks = [i / bins for i in range(1, bins)]
    asked = F.array(*[F.lit(r) for r in ranks])
    row = found.select(*[F.col(f"c{j}") if j in few else F.kll_sketch_get_quantile_double(f"c{j}", asked).alias(f"c{j}") for j in range(width)]).first()
    edges = []
    for j in range(width):
        values = np.unique(np.array(row[j], float))
        if j in few and len(values) > bins:  # the count of distinct values was an estimate
            values = values[np.unique(np.ceil(np.array(ranks) * len(values)).astype(int) - 1)]
            edges.append(values)
        else:
            edges.append(values[:-1] if j in few else values)
    return edges


@dataclass
class _Node:
    n: int
    total: float  # sum of gradients
    split: tuple | None = None  # gain, feature, bin, rows left, gradients left
    children: tuple[int, int] | None = None
    depth: int = 0


@dataclass
class _Growth:
    """A tree whose known splits may go beyond those that the order of gains takes."""

    nodes: list[_Node] = field(default_factory=list)

    def taken(self, limit: int) -> tuple[list[int], list[int]]:
        """Nodes split in order of gain, and, if the order cannot be followed to its end, the nodes to look below."""
        heap, split, leaves = [], [], 1
        if self.nodes[0].split:
            heap.append((-self.nodes[0].split[0], 0))
        while heap and leaves < limit:
            gain, at = heap[0]
            if self.nodes[at].children is None:
                unknown = [i for _, i in sorted(heap) if self.nodes[i].children is None]
                return split, unknown[: limit - leaves]
            heapq.heappop(heap)
            split.append(at)
            leaves += 1
            for child in self.nodes[at].children:
                if self.nodes[child].split:
                    heapq.heappush(heap, (-self.nodes[child].split[0], child))
        return split, []

    def known(self) -> Trees:
        """All splits known so far as one tree over bins; node numbers stay. The last two places are unused."""
        size = len(self.nodes)
        feature, number, left = np.full(size, -1), np.zeros(size), np.zeros(size, np.int64)
        for i, node in enumerate(self.nodes):
            if node.children:
                feature[i], number[i], left[i] = node.split[1], node.split[2], node.children[0]
        return Trees(np.zeros(1, np.int64), feature, number, left, np.zeros(size))

    def finished(self, split: list[int], l2: float) -> Trees:
        """The tree over bins with the splits taken; leaf values are the negative mean gradients."""
        inner = set(split)
        order, at = [0], 0
        while at < len(order):  # children side by side
            if order[at] in inner:
                order += self.nodes[order[at]].children
            at += 1
        place = {node: i for i, node in enumerate(order)}
        out = Trees(np.zeros(1, np.int64), np.full(len(order), -1), np.zeros(len(order)), np.zeros(len(order), np.int64), np.zeros(len(order)))
        for i, name in enumerate(order):
            node = self.nodes[name]
            if name in inner:
                out.gain[i], out.feature[i], out.number[i] = node.split[0], node.split[1], node.split[2]
                out.left[i] = place[node.children[0]]
            else:
                out.number[i] = -node.total / (node.n + l2) if node.n + l2 > 0 else 0.0
        return out


def _histograms(rows: DataFrame, since: list[Trees], rate: float, growth: _Growth, wanted: list[int], width: int, bins: int) -> DataFrame:
    """``node, feature, bin, n, g`` of the wanted nodes; a task adds up its rows first."""
    tree, recent = growth.known(), joined(since) if since else None
    slot = np.full(len(growth.nodes), -1)
    slot[wanted] = np.arange(len(wanted))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, g = np.zeros((width, len(wanted) * bins), np.int64), np.zeros((width, len(wanted) * bins))
        for batch in batches:
            x = matrix(batch.column(0), np.int64)
            if not len(x):
                continue
            gradient = batch.column(2).to_numpy() - batch.column(1).to_numpy()
            if recent is not None:
                gradient = gradient + rate * recent.sums(x)
            place = slot[tree.leaves(x, 0)]
            mine = place >= 0
            x, gradient, place = x[mine], gradient[mine], place[mine] * bins
            for j in range(width):
                n[j] += np.bincount(place + x[:, j], minlength=n.shape[1])
                g[j] += np.bincount(place + x[:, j], gradient, n.shape[1])
        n, g = n.reshape(-1, bins), g.reshape(-1, bins)  # feature by feature, its nodes in order
        met = np.flatnonzero(n.any(1))
        begins = np.arange(0, len(met) * bins + 1, bins, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(begins, v[met].ravel()) for v in (n, g)]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(wanted)[met % len(wanted)]), pa.array(met // len(wanted)), *lists], ["node", "feature", "n", "g"])

    return rows.mapInArrow(added, "node long, feature long, n array<long>, g array<double>")


def best_splits(histograms: DataFrame, least: int, l2: float) -> DataFrame:
    """``node, n, g, gain, feature, bin, left_n, left_g``: best splits of each node, one row for each part of the features.

    The tasks' histograms are dealt by node and feature and added up there. A split that does not gain, or leaves a
    side under ``least`` rows, has a null gain. Of equal gains the smaller feature and bin come first.
    """
    shape = "node long, n long, g double, gain double, feature long, bin long, left_n long, left_g double"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            n, g = matrix(batch.column(2), np.int64), matrix(batch.column(3))
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key in sums:
                    sums[key][0] += n[i]
                    sums[key][1] += g[i]
                else:
                    sums[key] = [n[i].copy(), g[i].copy()]
        rows: dict[int, tuple] = {}
        for (node, feature), (n, g) in sorted(sums.items()):
            left_n, left_g = n.cumsum(), g.cumsum()
            whole_n, whole_g = int(left_n[-1]), float(left_g[-1])
            right_n, right_g = whole_n - left_n, whole_g - left_g
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left_g**2 / (left_n + l2) + right_g**2 / (right_n + l2) - whole_g**2 / (whole_n + l2)
            gain = np.where((left_n >= max(least, 1)) & (right_n >= max(least, 1)) & (gain > 0), gain, 0.0)
            at = int(gain.argmax())
            if node not in rows:
                rows[node] = (node, whole_n, whole_g, None, None, None, None, None)
            if gain[at] > (rows[node][3] or 0.0):
                rows[node] = (*rows[node][:3], float(gain[at]), feature, at, int(left_n[at]), float(left_g[at]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i in (2, 3, 7) else pa.int64()) for i, c in enumerate(zip(*rows.values()))],
                                             [f.split()[0] for f in shape.split(", ")])

    return histograms.repartition("node", "feature").mapInArrow(best, shape)


class HistogramBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees of at most ``maxLeaves`` leaves, with an L2 penalty on leaf values.

    ``maxDepth`` 0 sets no depth limit. An empty table gives a model that predicts 0.
    """

    maxLeaves = Param(Params._dummy(), "maxLeaves", "largest number of leaves of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth, 0 for none", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "penalty on leaf values", TypeConverters.toFloat)
    accuracy = Param(Params._dummy(), "accuracy", "rank error of bin edges", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100, stepSize=0.1, maxLeaves=31,
                 minInstancesPerNode=20, maxDepth=0, maxBins=255, l2=0.0, accuracy=0.001):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, maxIter=maxIter, stepSize=stepSize, maxLeaves=maxLeaves,
                  minInstancesPerNode=minInstancesPerNode, maxDepth=maxDepth, maxBins=maxBins, l2=l2, accuracy=accuracy)

    def setParams(self, **values):
        return self._set(**values)

    def _fit(self, dataset: DataFrame) -> TreeSumModel:
        get = self.getOrDefault
        source = stage(dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")), "boosting")
        base, width, count = source.agg(F.avg("y"), F.max(F.size("x")), F.count("*")).first()
        blank = Trees(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
        if not count:
            return self._copyValues(TreeSumModel(blank, 0.0, 1.0, 0))
        bins, rate, l2, least = get(self.maxBins), self.getStepSize(), get(self.l2), get(self.minInstancesPerNode)
        edges = bin_edges(source, width, bins, get(self.accuracy))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0))
                cells = np.zeros(x.shape, np.int16)
                for j, cuts in enumerate(edges[: x.shape[1]]):
                    cells[:, j] = np.searchsorted(cuts, x[:, j], "left")
                lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, max(width, 1), dtype=np.int32), cells.ravel())
                yield pa.RecordBatch.from_arrays([lists, batch.column(1), pa.array(np.full(len(x), base))], ["x", "y", "f"])

        shape = "x array<smallint>, y double, f double"
        rows, since, trees = stage(source.mapInArrow(binned, shape), "boosting-bins"), [], []
        for _ in range(self.getMaxIter()):
            growth, split = self._grown(rows, since, rate, width, bins, count)
            if not split:
                break  # no split gains any more, nor would it in later rounds
            trees.append(growth.finished(split, l2))
            since.append(trees[-1])
            if len(since) == _CARRY:
                rows, since = stage(rows.mapInArrow(_carried(joined(since), rate), shape), "boosting-rows"), []
        whole = joined(trees) if trees else blank
        inner = whole.feature >= 0
        cuts = whole.number.copy()
        cuts[inner] = [edges[f][int(b)] for f, b in zip(whole.feature[inner], whole.number[inner])]
        return self._copyValues(TreeSumModel(Trees(whole.roots, whole.feature, cuts, whole.left, whole.gain), base, rate, width))

    def _grown(self, rows: DataFrame, since: list[Trees], rate: float, width: int, bins: int, count: int) -> tuple[_Growth, list[int]]:
        get = self.getOrDefault
        limit, least, l2, deepest = get(self.maxLeaves), get(self.minInstancesPerNode), get(self.l2), get(self.maxDepth)
        growth, wanted = _Growth([_Node(count, 0.0)]), [0]
        while True:
            if wanted:
                found = best_splits(_histograms(rows, since, rate, growth, wanted, width, bins), least, l2)
                # at most one row a node and partition
                for r in sorted(found.collect(), key=lambda r: (-(r["gain"] or 0.0), r["feature"] or 0)):
                    node = growth.nodes[r["node"]]
                    if node.split is None:
                        node.n, node.total = r["n"], r["g"]
                        node.split = tuple(r[3:]) if r["gain"] else None
            split, below = growth.taken(limit)
            if not below:
                return growth, split
            wanted = []
            for at in below:
                node = growth.nodes[at]
                _, _, _, left_n, left_g = node.split
                node.children = (len(growth.nodes), len(growth.nodes) + 1)
                for n, g in ((left_n, left_g), (node.n - left_n, node.total - left_g)):
                    growth.nodes.append(_Node(n, g, depth=node.depth + 1))
                    if n >= 2 * least and n > 1 and (not deepest or node.depth + 1 < deepest):
                        wanted.append(len(growth.nodes) - 1)


def _carried(trees: Trees, rate: float):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), np.int64)
            f = batch.column(2).to_numpy() + rate * trees.sums(x) if len(x) else batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f)], ["x", "y", "f"])

    return add
