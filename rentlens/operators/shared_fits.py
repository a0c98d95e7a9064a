"""Penalised lines and support-vector fits of many row sets in shared passes: the whole table, and all rows but one fold.

Sums of products by fold give scaler and line of every row set, since those of a set are the sums of its folds.
A line is solved by MLlib's own solver from a few weighted points that have count, means and products of the
set. The support-vector fits of all sets take their Newton steps side by side: a pass reads the rows once,
makes the kernel features of each set in blocks, and adds up what each fit asks for. Nothing is stored a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from numpy.polynomial import Chebyshev, Polynomial
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.operators.support_vectors import SupportVectorModel, SupportVectorRegression, added, solving

_BLOCK = 1000
_AT_ONCE = 8
# cosine of the square root over the squares of a quarter turn, within rounding
_COSINE = Chebyshev.interpolate(lambda u: np.cos(np.sqrt(np.maximum(u, 0))), 9, [0, (np.pi / 2) ** 2]).convert(kind=Polynomial).coef


def cosines(z: np.ndarray) -> np.ndarray:
    """Cosines, written over ``z``: those of half angles by a polynomial, then doubled. numpy's own take twice as long."""
    z *= 0.5 / np.pi
    u = np.rint(z)
    np.subtract(z, u, out=z)
    z *= np.pi
    np.multiply(z, z, out=u)
    z[:] = _COSINE[-1]
    for c in _COSINE[-2::-1]:
        z *= u
        z += c
    np.multiply(z, z, out=z)
    z *= 2.0
    z -= 1.0
    return z


def shares_passes(regressor: Estimator) -> bool:
    """Whether a regressor can be fitted here: a penalised line, or a support-vector regression on kernel features.

    A line without a penalty has no single best one where columns depend on each other. Where its solver then ends
    hangs on the last bits of the sums, so it keeps its own passes over the rows.
    """
    if isinstance(regressor, LinearRegression):
        return regressor.getSolver() == "normal" and regressor.getLoss() == "squaredError" and regressor.getRegParam() > 0
    return isinstance(regressor, SupportVectorRegression) and regressor.getFeaturesCol() == "kernel"


@dataclass
class Moments:
    """Rows, means and centred products of features and, last, label. A column of one value has products of 0."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @cached_property
    def deviation(self) -> np.ndarray:
        """Sample deviations of the features."""
        return np.sqrt(np.maximum(np.diag(self.products)[:-1], 0) / max(self.n - 1, 1))

    @cached_property
    def factor(self) -> np.ndarray:
        """What the scaler multiplies centred features by."""
        return np.divide(1.0, self.deviation, out=np.zeros(len(self.deviation)), where=self.deviation > 0)

    def points(self) -> np.ndarray:
        """Scaled features and label of points that have, each weighted ``n / len``, these means and products."""
        factor = np.append(self.factor, 1.0)
        values, axes = np.linalg.eigh(self.products * factor * factor[:, None] / max(self.n, 1))
        steps = (axes * np.sqrt(np.maximum(values, 0) * len(values))).T
        steps[:, np.diag(self.products) <= 0] = 0.0
        out = np.vstack([steps, -steps])
        out[:, -1] += self.mean[-1]
        return out


@dataclass
class Projection:
    """``cos((x - mean) * factor @ lines + phases) * sqrt(2 / size)`` of one row set."""

    lines: np.ndarray
    phases: np.ndarray

    @classmethod
    def of(cls, moments: Moments, lines: np.ndarray, phases: np.ndarray) -> Projection:
        scaled = lines * moments.factor[:, None]
        return cls(scaled, phases - moments.mean[:-1] @ scaled)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Kernel features of some rows, with a 1 at the end."""
        size = self.lines.shape[1]
        out = np.empty((len(x), size + 1))
        waves = x @ self.lines
        waves += self.phases
        np.multiply(cosines(waves), np.sqrt(2 / size), out=out[:, :size])
        out[:, size] = 1.0
        return out


@dataclass
class Fit:
    """Prediction ``x @ weights + intercept``, of kernel features where there is a projection; and its stages of a pipeline."""

    weights: np.ndarray
    intercept: float
    projection: Projection | None
    stages: list[Model]

    def predicted(self, x: np.ndarray) -> np.ndarray:
        if self.projection is None:
            return x @ self.weights + self.intercept
        return self.projection.rows(x) @ np.append(self.weights, self.intercept)


def _columns(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The first columns as a matrix, which may hold no gap."""
    if any(batch.column(j).null_count for j in range(width)):
        raise ValueError("a feature is null: fill the gaps with an imputer")
    return np.column_stack([batch.column(j).to_numpy() for j in range(width)]) if width else np.empty((batch.num_rows, 0))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and folds of some rows at a time, from feature columns, a label and a fold."""
    for batch in batches:
        for start in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(start, _BLOCK)
            x = _columns(part, width)
            if np.isnan(x).any():
                raise ValueError("a feature is not a number")
            yield x, part.column(width).to_numpy(), part.column(width + 1).to_numpy()


def _numbers(rows: DataFrame, names: Sequence[str], label: str, fold: str | None) -> DataFrame:
    place = F.col(fold) if fold is not None else F.lit(0)
    return rows.select(*[F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)],
                       F.col(label).cast("double").alias("y"), F.coalesce(place, F.lit(-1)).cast("int").alias("fold"))


def moments(numbers: DataFrame, width: int, sets: Sequence[int | None], k: int) -> list[Moments]:
    """Moments of each row set: all rows for None, else all but those of a fold.

    A first pass takes count, sum and bounds of each fold and column, a second the products about the means.
    """
    folds = max(k, 1)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(folds), np.zeros((folds, width + 1))
        low, high = np.full((folds, width + 1), np.inf), np.full((folds, width + 1), -np.inf)
        for x, y, fold in _blocks(batches, width):
            z = np.column_stack([x, y])
            for i in np.unique(fold[(fold >= 0) & (fold < folds)]) if k else (0,):
                mine = z[fold == i] if k else z
                n[i] += len(mine)
                total[i] += mine.sum(0)
                low[i], high[i] = np.minimum(low[i], mine.min(0)), np.maximum(high[i], mine.max(0))
        at = np.flatnonzero(np.repeat(n, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(v.ravel()[at]) for v in (np.repeat(n[:, None], width + 1, 1), total, low, high)]],
                                         ["at", "n", "total", "low", "high"])

    found = numbers.mapInArrow(spans, "at long, n double, total double, low double, high double").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    at = found.column("at").to_numpy()
    n, total, low, high = (np.full(folds * (width + 1), v) for v in (0.0, 0.0, np.inf, -np.inf))
    for name, out in (("n", n), ("total", total), ("low", low), ("high", high)):
        out[at] = found.column(name).to_numpy()
    n, total, low, high = (v.reshape(folds, width + 1) for v in (n, total, low, high))
    centre = total.sum(0) / max(n[:, 0].sum(), 1)
    size = width + 2

    def products_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x, y, fold in _blocks(batches, width):
            z = np.column_stack([x, y]) - centre
            z = np.column_stack([z, np.ones(len(z))])
            out = np.zeros((folds, size, size))
            for i in np.unique(fold[(fold >= 0) & (fold < folds)]) if k else (0,):
                mine = z[fold == i] if k else z
                out[i] = mine.T @ mine
            yield out.ravel()

    sums = added(numbers, products_of)
    sums = (sums if sums.size else np.zeros(folds * size * size)).reshape(folds, size, size)
    out = []
    for left_out in sets:
        mine = [i for i in range(folds) if i != left_out]
        s, count = sums[mine].sum(0), float(n[mine, 0].sum())
        shift = s[:-1, -1] / max(count, 1)
        one = low[mine].min(0) >= high[mine].max(0)
        about = s[:-1, :-1] - count * np.outer(shift, shift)
        about[one] = 0.0
        about[:, one] = 0.0
        mean = np.where(one, low[mine].min(0), centre + shift)
        out.append(Moments(count, mean, about))
    return out


def _line(spark, regressor: LinearRegression, found: Moments, scaler: StandardScalerModel) -> Fit:
    points = found.points()
    few = spark.createDataFrame([(Vectors.dense(p[:-1]), float(p[-1]), found.n / len(points)) for p in points], ["features", "y", "weight"]).coalesce(1)
    asked = regressor.copy()
    model = asked.setParams(featuresCol="features", labelCol="y", weightCol="weight").fit(few)
    model.clear(model.weightCol)
    model.set(model.labelCol, regressor.getLabelCol())
    weights = model.coefficients.toArray() * found.factor
    return Fit(weights, model.intercept - found.mean[:-1] @ weights, None, [scaler, model])


def _scaler(spark, estimator: StandardScaler, found: Moments) -> StandardScalerModel:
    """Fitted by two points that have the means and deviations."""
    reach = found.deviation / np.sqrt(2)
    two = [(Vectors.dense(found.mean[:-1] + s * reach),) for s in (-1, 1)]
    return estimator.fit(spark.createDataFrame(two, [estimator.getInputCol()]).coalesce(1))


def fitted(
    rows: DataFrame, names: Sequence[str], regressors: Mapping[str, Estimator], kernels: Mapping[str, Transformer], sets: Sequence[int | None],
    k: int, label: str, scaler: StandardScaler, fold: str = "fold",
) -> dict[str, list[Fit]]:
    """Fits of each regressor for each row set. ``kernels`` gives the Fourier stage of a support-vector regression."""
    spark, width = rows.sparkSession, len(names)
    numbers = _numbers(rows, names, label, fold if k else None)
    found = moments(numbers, width, sets, k)
    lines = [name for name, r in regressors.items() if isinstance(r, LinearRegression)]
    # fits of a few points are mostly waiting, so they run side by side
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        side_by_side = lambda work, *items: list(pool.map(inheritable_thread_target(spark)(work), *items))
        scalers = side_by_side(lambda m: _scaler(spark, scaler, m), found)
        solved = side_by_side(lambda pair: _line(spark, regressors[pair[0]], found[pair[1]], scalers[pair[1]]), list(product(lines, range(len(sets)))))
    out = {name: solved[i * len(sets) : (i + 1) * len(sets)] for i, name in enumerate(lines)}
    asked, places = [], []
    for name, r in regressors.items():
        if name in out:
            continue
        stage = kernels[name]
        out[name] = []
        for left_out, m, s in zip(sets, found, scalers):
            projection = Projection.of(m, *stage.waves())
            asked.append((projection, left_out, solving(stage.getOrDefault(stage.size), m.n, m.mean[-1], r.getOrDefault(r.c), r.getOrDefault(r.epsilon))))
            places.append((name, r, projection, [s, stage]))
    for (name, r, projection, stages), weights in zip(places, _together(numbers, width, asked)):
        model = r._copyValues(SupportVectorModel(weights[:-1].tolist(), weights[-1]))
        out[name].append(Fit(weights[:-1], float(weights[-1]), projection, [*stages, model]))
    return {name: out[name] for name in regressors}


def _together(numbers: DataFrame, width: int, asked: Sequence[tuple]) -> list[np.ndarray]:
    """Weights of several support-vector fits whose passes over the rows are shared."""
    done, wants = {}, {}

    def go_on(i: int, sums: np.ndarray | None) -> None:
        try:
            wants[i] = asked[i][2].send(sums)
        except StopIteration as end:
            wants.pop(i, None)
            done[i] = end.value[0]

    for i in range(len(asked)):
        go_on(i, None)
    while wants:
        now = [(asked[i][0], asked[i][1], want) for i, want in wants.items()]

        def parts(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[np.ndarray]:
            for x, y, fold in _blocks(batches, width):
                found = []
                for projection, left_out, want in now:
                    mine = slice(None) if left_out is None else fold != left_out
                    found.append(want(projection.rows(x[mine]), y[mine]))
                yield np.concatenate(found)

        sums, ends = added(numbers, parts), np.cumsum([want.size for _, _, want in now])
        for i, part in zip(list(wants), np.split(sums, ends[:-1])):
            go_on(i, part)
    return [done[i] for i in range(len(asked))]


def predictions(df: DataFrame, names: Sequence[str], fits: Mapping[str, Sequence[Fit]], target: str, fold: str | None = None) -> DataFrame:
    """``model, fold, <target>, log_prediction`` of every row by each model's fit, that of its fold where one is named."""
    width, models = len(names), list(fits)
    fits = {name: [replace(f, stages=[]) for f in found] for name, found in fits.items()}  # stages stay on the driver
    numbers = _numbers(df, names, target, fold)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, place in _blocks(batches, width):
            out = np.full((len(models), len(x)), np.nan)
            for i in np.unique(place):
                if i < 0 or i >= len(fits[models[0]]):
                    continue
                mine = place == i
                for m, model in enumerate(models):
                    out[m, mine] = fits[model][i].predicted(x[mine])
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(y), *[pa.array(v) for v in out]], ["fold", "y", *[f"p{m}" for m in range(len(models))]])

    shape = "fold int, y double" + "".join(f", p{m} double" for m in range(len(models)))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p{i}").alias("log_prediction")) for i, m in enumerate(models)]))
    return numbers.mapInArrow(predicted, shape).select("fold", F.col("y").alias(target), pairs.alias("p")).select("p.model", "fold", target, "p.log_prediction")
