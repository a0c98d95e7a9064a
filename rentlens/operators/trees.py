"""Regression trees as flat arrays, and the fitted model that adds them up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass
class Trees:
    """Nodes of all trees. ``roots[t]`` is the first node of tree ``t``; a leaf has feature -1 and its value in
    ``number``, any other node its threshold; rows up to the threshold go to ``left``, others to ``left + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    number: np.ndarray
    left: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Leaf of each row of ``x`` in one tree."""
        at = np.full(len(x), self.roots[tree])
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            node = at[inner]
            right = x[inner, self.feature[node]] > self.number[node]
            at[inner] = self.left[node] + right
            inner = inner[self.feature[at[inner]] >= 0]
        return at

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of all trees' values for each row."""
        total = np.zeros(len(x))
        for tree in range(len(self.roots)):
            total += self.number[self.leaves(x, tree)]
        return total


def joined(parts: list[Trees]) -> Trees:
    """All trees in one set of arrays."""
    shifts = np.cumsum([0, *[len(p.feature) for p in parts]])
    pick = lambda name: np.concatenate([getattr(p, name) for p in parts]) if parts else np.zeros(0)
    moved = lambda name: np.concatenate([getattr(p, name) + s for p, s in zip(parts, shifts)]) if parts else np.zeros(0, np.int64)
    return Trees(moved("roots"), pick("feature"), pick("number"), moved("left"), pick("gain"))


def matrix(column: pa.Array, kind=float) -> np.ndarray:
    """Arrow lists of one length as rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        t = self.instance.trees
        more = {"base": self.instance.base, "scale": self.instance.scale, "width": self.instance.width}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"figures": more})
        root = np.zeros(len(t.feature), bool)
        root[t.roots] = True
        nodes = pa.table({"id": np.arange(len(t.feature)), "root": root, "feature": t.feature.astype(np.int32), "number": t.number, "node_left": t.left, "gain": t.gain})
        self.sparkSession.createDataFrame(nodes).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("id").toArrow()
        get = lambda name: nodes.column(name).to_numpy()
        figures = metadata["figures"]
        trees = Trees(np.flatnonzero(get("root")), get("feature"), get("number"), get("node_left"), get("gain"))
        model = self.kind(trees, figures["base"], figures["scale"], figures["width"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TreeSumModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """``base + scale * sum of trees``. The trees travel to the tasks as one broadcast; their size is the number
    of nodes, which the trainer's depth, leaf and row limits bound."""

    def __init__(self, trees: Trees | None = None, base: float = 0.0, scale: float = 1.0, width: int = 0):
        super().__init__()
        self.trees, self.base, self.scale, self.width = trees, base, scale, width

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, scale = self.base, self.scale
        held = dataset.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf(DoubleType())
        def predicted(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return pd.Series([], dtype=float)
            return pd.Series(base + scale * held.value.sums(np.stack(rows.to_numpy())))

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(self.getFeaturesCol()))))

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gains of all splits."""
        inner = self.trees.feature >= 0
        gains = np.bincount(self.trees.feature[inner].astype(int), self.trees.gain[inner], self.width)
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)
