"""Support-vector regression on the features it is given: epsilon-insensitive loss with an L2 penalty.

The objective is ``|w|**2 / 2 + C * sum(max(0, |y - w.x - b| - epsilon))``. The loss has a corner, so it is solved
through smooth ones: a parabola of shrinking width takes the corner's place, each problem starts from the last
solution, and each step is a damped Newton step. Tasks add up gradient and curvature of their rows in Arrow
batches, Spark adds those of the tasks by position, and the driver solves a system of one row a feature. A pass
gives the objective at the whole step and at several shorter ones; where the whole step goes too far, a further
pass takes the best of them.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.operators.trees import matrix
from rentlens.session import stage

# widths of the parabola in epsilons, and step lengths that are tried
_WIDTHS = (1.0, 0.2, 0.05, 0.01)
_STEPS = np.array([0.6, 0.3, 0.1, 0.03, 0.01, 0.001])
_ROUNDS = 12
_ENOUGH = 1e-4


def _loss(residual: np.ndarray, epsilon: float, width: float) -> np.ndarray:
    """0 up to epsilon, then a parabola over twice the width, then the line."""
    over = np.abs(residual) - epsilon
    return np.where(over <= 0, 0.0, np.where(over < 2 * width, over * over / (4 * width), over - width))


def added(rows: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Sum over all rows of the arrays of one length that ``parts`` gives for the batches of a task; empty without any."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts(batches):
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    found = rows.mapInArrow(totals, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    return found.column("v").to_numpy()[np.argsort(found.column("at").to_numpy())]


@dataclass
class Wanted:
    """What a pass adds up: loss, gradient and curvature at one point for some widths, and the loss at further points."""

    epsilon: float
    point: np.ndarray
    widths: Sequence[float]
    further: np.ndarray | None = None

    @property
    def size(self) -> int:
        p = len(self.point)
        return len(self.widths) * (1 + p + p * (p + 1) // 2) + (0 if self.further is None else len(self.further))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sums for some rows of features, with a 1 at the end, and targets."""
        residual, out = y - x @ self.point, []
        over, upper = np.abs(residual) - self.epsilon, np.triu_indices(len(self.point))
        for width in self.widths:
            pull = np.clip(over / (2 * width), 0, 1) * np.sign(residual)
            bent = x[(over > 0) & (over < 2 * width)]
            out += [[_loss(residual, self.epsilon, width).sum()], -(pull @ x), (bent.T @ bent)[upper] / (2 * width)]
        if self.further is not None:
            out.append(_loss(y[:, None] - x @ self.further.T, self.epsilon, self.widths[0]).sum(0))
        return np.concatenate(out)


def solving(size: int, count: float, start: float, c: float, epsilon: float) -> Generator[Wanted, np.ndarray, tuple[np.ndarray, float]]:
    """Gives what the next pass has to add up, is sent the sums, and ends with weights, the intercept last, and the
    smoothed objective a row.

    A pass for a whole step takes along the shorter ones and the next width, so that going on there costs no further pass.
    """
    weights = np.append(np.zeros(size), start)
    penalty = np.append(np.full(size, 1 / (c * count)), 0.0)
    widths = [share * max(epsilon, 1e-6) for share in _WIDTHS]
    upper = np.triu_indices(size + 1)

    def measured(sums: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, gradient and curvature."""
        half = np.zeros((size + 1, size + 1))
        half[upper] = sums[size + 2 :]
        curve = half + half.T - np.diag(np.diag(half)) + np.diag(penalty)
        return float(sums[0] + (w**2 * penalty).sum() / 2), sums[1 : size + 2] + penalty * w, curve

    def asked(w: np.ndarray, level: int, points: np.ndarray | None = None):
        """Measures at the width of a level and the next one, and objectives at the further points."""
        mine = widths[level : level + 2]
        sums = (yield Wanted(epsilon, w, mine, points)) / count
        parts = np.split(sums, np.arange(1, len(mine) + 1) * (len(sums) - (0 if points is None else len(points))) // len(mine))
        values = None if points is None else parts[-1] + (points**2 * penalty).sum(1) / 2
        found = [measured(part, w) for part in parts[: len(mine)]]
        return found[0], found[-1], values

    current, ahead, _ = yield from asked(weights, 0)
    for level in range(len(widths)):
        here, gradient, curve = current
        for _ in range(_ROUNDS):
            step = -np.linalg.solve(curve + np.eye(size + 1) * 1e-9 * max(np.trace(curve), 1e-9), gradient)
            length = 1.0
            there, beyond, values = yield from asked(weights + step, level, weights + _STEPS[:, None] * step)
            if there[0] >= here:  # the whole step goes too far
                length = _STEPS[values.argmin()]
                if values.min() >= here:
                    break
                there, beyond, _ = yield from asked(weights + length * step, level)
            weights, ahead = weights + length * step, beyond
            gained = here - there[0]
            here, gradient, curve = there
            if gained <= _ENOUGH * max(here, 1e-12):
                break
        if level + 1 < len(widths):
            if ahead is None:  # no step was taken at this width
                current, ahead, _ = yield from asked(weights, level + 1)
            else:
                current, ahead = ahead, None
    return weights, here


def solved(rows: DataFrame, size: int, count: int, start: float, c: float, epsilon: float) -> tuple[np.ndarray, float]:
    """Weights, the intercept last, and the smoothed objective a row, from columns ``x`` and ``y``."""
    fit = solving(size, count, start, c, epsilon)
    wanted = next(fit)
    while True:

        def parts(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[np.ndarray]:
            for batch in batches:
                x = matrix(batch.column(0))
                if len(x):
                    yield wanted(np.hstack([x, np.ones((len(x), 1))]), batch.column(1).to_numpy())

        try:
            wanted = fit.send(added(rows, parts))
        except StopIteration as end:
            return end.value


class SupportVectorModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Inner product with the weights, and the intercept."""

    weights = Param(Params._dummy(), "weights", "weights of the features", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    def __init__(self, weights=(), intercept=0.0):
        super().__init__()
        self._set(weights=list(weights), intercept=float(intercept))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.getOrDefault(self.weights)]) if self.getOrDefault(self.weights) else F.array().cast("array<double>")
        products = F.zip_with(vector_to_array(F.col(self.getFeaturesCol())), weights, lambda a, b: a * b)
        return dataset.withColumn(self.getPredictionCol(), F.aggregate(products, F.lit(self.getOrDefault(self.intercept)), lambda s, v: s + F.coalesce(v, F.lit(0.0))))


class SupportVectorRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """``c`` weighs the loss against the penalty, errors up to ``epsilon`` cost nothing. No rows give a model of 0."""

    c = Param(Params._dummy(), "c", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "error that costs nothing", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", c=100.0, epsilon=0.08):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, c=c, epsilon=epsilon)

    def setParams(self, **values):
        return self._set(**values)

    def _fit(self, dataset: DataFrame) -> SupportVectorModel:
        rows = stage(dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")), "vectors")
        count, size, start = rows.agg(F.count("*"), F.max(F.size("x")), F.avg("y")).first()
        if not count:
            return self._copyValues(SupportVectorModel())
        weights, _ = solved(rows, size, count, start, self.getOrDefault(self.c), self.getOrDefault(self.epsilon))
        return self._copyValues(SupportVectorModel(weights[:-1].tolist(), weights[-1]))
