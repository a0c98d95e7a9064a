"""Training and comparing regressors on a log-price target with MLlib."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rentlens import vocab
from rentlens.operators import shared_fits
from rentlens.operators.boosting import HistogramBoosting
from rentlens.operators.folds import fold_column
from rentlens.operators.quantiles import column_quantiles
from rentlens.operators.random_trees import ExtraTrees
from rentlens.operators.support_vectors import SupportVectorRegression
from rentlens.operators.trees import matrix
from rentlens.session import stage

LABEL = "log_label"
LOG_PREDICTION = "log_prediction"


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: cosines of random projections, whose inner products approach an RBF
    kernel of width ``gamma``."""

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    inputs = Param(Params._dummy(), "inputs", "length of the input vector", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=64, gamma=0.03, inputs=1, seed=42):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        for name, value in (("size", size), ("gamma", gamma), ("inputs", inputs), ("seed", seed)):
            self._set(**{name: value})

    def waves(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions and phases of the cosines."""
        size, inputs = self.getOrDefault(self.size), self.getOrDefault(self.inputs)
        draw = np.random.default_rng(self.getSeed())
        lines = draw.normal(0.0, math.sqrt(2 * self.getOrDefault(self.gamma)), (inputs, size))
        return lines, draw.uniform(0.0, 2 * math.pi, size)

    def _transform(self, dataset):
        size = self.getOrDefault(self.size)
        lines, phases = self.waves()

        @F.arrow_udf(ArrayType(DoubleType()))
        def cosines(rows: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.list_(pa.float64()))
            waves = np.cos(matrix(rows) @ lines + phases) * math.sqrt(2 / size)
            return pa.ListArray.from_arrays(np.arange(0, waves.size + 1, size, dtype=np.int32), waves.ravel())

        values = vector_to_array(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(cosines(values)))


def with_label(df: DataFrame, target: str = vocab.TARGET) -> DataFrame:
    return df.withColumn(LABEL, F.log1p(target))


def fit_imputer(df: DataFrame, names: Sequence[str]) -> SQLTransformer:
    """Stage that fills nulls by the exact median of the training rows; an all-null column gets 0."""
    medians = column_quantiles(df, names, {"median": 0.5})
    found = {r["measure"]: r["median"] for r in medians.take(len(names))}
    fills = ", ".join(f"coalesce(`{n}`, {found.get(n, 0.0)!r}D) AS `{n}`" for n in names)
    kept = ", ".join(f"`{n}`" for n in names)
    return SQLTransformer(statement=f"SELECT * EXCEPT ({kept}), {fills} FROM __THIS__")


def scaler() -> StandardScaler:
    """Centred and scaled by the sample deviation; a constant column becomes 0."""
    return StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True)


def kernel_features(names: Sequence[str]) -> FourierFeatures:
    """Features of the support-vector regression; the width is that of scaled columns."""
    return FourierFeatures(inputCol="features", outputCol="kernel", inputs=len(names), gamma=1 / len(names))


def to_price() -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, expm1({LOG_PREDICTION}) AS prediction FROM __THIS__")


def pipeline(names: Sequence[str], regressor: Estimator, imputer: SQLTransformer | None = None) -> Pipeline:
    """Impute, assemble, scale, regress the log price, give a price."""
    regressor.setParams(labelCol=LABEL, predictionCol=LOG_PREDICTION)
    first = [imputer] if imputer is not None else []
    assemble = VectorAssembler(inputCols=list(names), outputCol="assembled")
    middle = [assemble, scaler()]
    if regressor.getFeaturesCol() == "kernel":
        middle.append(kernel_features(names))
    return Pipeline(stages=[*first, *middle, regressor, to_price()])


def label_figures(df: DataFrame, target: str = vocab.TARGET) -> tuple[int, float]:
    """Rows and sample deviation of the log target, which scale the penalties."""
    n, sigma = df.agg(F.count("*"), F.stddev(F.log1p(target))).first()
    return n, sigma or 1.0


def ridge(n: int, sigma: float, alpha: float = 3.0) -> LinearRegression:
    """Penalty ``alpha`` on the sum of squares, as MLlib's mean loss of a scaled label states it.

    Solved from the products of the columns, which one pass over the rows adds up. That solver scales the label
    by its population deviation.
    """
    population = sigma * math.sqrt((n - 1) / n)
    return LinearRegression(elasticNetParam=0.0, regParam=alpha * population / n, standardization=False, solver="normal",
                            maxIter=200, tol=1e-9)


def elastic_net(sigma: float, alpha: float = 0.03, l1: float = 0.2) -> LinearRegression:
    """Both penalties, with the steps taken on the products of the columns instead of the rows."""
    first, second = alpha * l1, alpha * (1 - l1) * sigma
    return LinearRegression(elasticNetParam=first / (first + second), regParam=first + second, standardization=False,
                            solver="normal", maxIter=200, tol=1e-9)


def regressors(
    n: int, sigma: float, trees: int | None = None, depth: int | None = None, rounds: int = 100, seed: int = 42
) -> dict[str, Estimator]:
    """Untuned regressors by name. ``trees``, ``depth`` and ``rounds`` bound the size of tree models."""
    return {
        "Linear Regression": LinearRegression(),
        "Ridge Regression": ridge(n, sigma),
        "ElasticNet": elastic_net(sigma),
        "Random Forest": RandomForestRegressor(
            numTrees=trees or 400, maxDepth=depth or 30, featureSubsetStrategy="all", seed=seed),
        "Extra Trees": ExtraTrees(numTrees=trees or 500, maxDepth=depth or 0, seed=seed),
        "Support Vector Regression": SupportVectorRegression(featuresCol="kernel", c=100.0, epsilon=0.08),
        "Gradient Boosting": GBTRegressor(maxIter=rounds, stepSize=0.1, maxDepth=depth or 3, seed=seed),
        "Histogram Gradient Boosting": HistogramBoosting(maxIter=rounds, stepSize=0.1, maxLeaves=31, minInstancesPerNode=20),
    }


def comparison_regressors(n: int, sigma: float, seed: int = 42) -> dict[str, Estimator]:
    """Regressors by which feature sets are compared, at their published sizes."""
    return {
        "Ridge": ridge(n, sigma),
        "RandomForest": RandomForestRegressor(
            numTrees=500, maxDepth=14, minInstancesPerNode=2, featureSubsetStrategy="all", seed=seed),
        "HistGradientBoosting": HistogramBoosting(maxIter=500, stepSize=0.05, maxDepth=8),
        "SVR": SupportVectorRegression(featuresCol="kernel", c=80.0, epsilon=0.06),
    }


def regression_metrics(predictions: DataFrame | GroupedData, target: str = vocab.TARGET) -> DataFrame:
    """MAE, RMSE, R2 and MAPE in one aggregate, or one a group."""
    y, error = F.col(target), F.col(target) - F.col("prediction")
    tiny = 2.220446049250313e-16
    total = F.var_pop(y) * F.count(y)
    return predictions.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(total > 0, 1 - F.sum(error * error) / total).alias("r2"),
        (F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(tiny))) * 100).alias("mape"),
    )


def cross_validate(df: DataFrame, estimator: Estimator, k: int, fold: str = "fold") -> DataFrame:
    """Metrics per fold of rows that carry a fold column."""
    parts = []
    for i in range(k):
        model = estimator.fit(df.where(F.col(fold) != i))
        scored = model.transform(df.where(F.col(fold) == i))
        parts.append(regression_metrics(scored).select(F.lit(i).alias("fold"), "*"))
    return reduce(DataFrame.unionByName, parts)


def cv_summary(folds: DataFrame | GroupedData) -> DataFrame:
    return folds.agg(
        F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"), F.avg("rmse").alias("cv_rmse_mean"),
        F.avg("mae").alias("cv_mae_mean"),
    )


def draw_settings(space: Mapping[str, Sequence], n_iter: int = 12, seed: int = 42) -> list[dict]:
    """Distinct random settings of a search space, the same for the same seed."""
    draw = random.Random(seed)
    total = math.prod(len(v) for v in space.values())
    out = []
    for code in draw.sample(range(total), min(n_iter, total)):
        setting = {}
        for name, values in space.items():
            code, i = divmod(code, len(values))
            setting[name] = values[i]
        out.append(setting)
    return out


def random_search(
    df: DataFrame, names: Sequence[str], regressor: Estimator, space: Mapping[str, Sequence], n_iter: int = 12,
    folds: int = 4, seed: int = 42, parallelism: int = 2, key: str = "listing_id", imputer=None,
) -> CrossValidatorModel:
    """Best of random settings by RMSE in price units, over contiguous folds. ``imputer`` fills gaps first."""
    maps = [
        {regressor.getParam(p): v for p, v in setting.items()} for setting in draw_settings(space, n_iter, seed)
    ]
    search = CrossValidator(
        estimator=pipeline(names, regressor, imputer), estimatorParamMaps=maps, foldCol="search_fold", numFolds=folds,
        evaluator=RegressionEvaluator(labelCol=vocab.TARGET, predictionCol="prediction", metricName="rmse"),
        parallelism=parallelism, seed=seed,
    )
    return search.fit(stage(with_label(fold_column(df, folds, key, name="search_fold")), "search"))


def importances(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float]]:
    """Features of a tree model by importance; other models have none."""
    for stage in model.stages:
        if hasattr(stage, "featureImportances"):
            values = stage.featureImportances.toArray()
            return sorted(((n, float(v)) for n, v in zip(names, values, strict=True)), key=lambda p: (-p[1], p[0]))
    return []


def actual_vs_predicted(predictions: DataFrame, target: str = vocab.TARGET, key: str = "listing_id") -> DataFrame:
    """Pairs for a chart, each with the common limits of both axes."""
    limits = predictions.agg(F.struct(
        F.least(F.min(target), F.min("prediction")).alias("low"),
        F.greatest(F.max(target), F.max("prediction")).alias("high"),
    ).alias("limits")).scalar()
    return predictions.select(key, F.col(target).alias("actual"), F.col("prediction").alias("predicted"),
                              limits["low"].alias("axis_low"), limits["high"].alias("axis_high"))


def evaluate(
    name: str, estimator: Estimator, train: DataFrame, test: DataFrame, k: int = 5
) -> tuple[PipelineModel, DataFrame]:
    """Fitted model and its row of the comparison table: test metrics, fit seconds, cross-validation."""
    start = time.monotonic()
    model = estimator.fit(train)
    seconds = time.monotonic() - start
    row = regression_metrics(model.transform(test))
    if k > 1:
        cv = cv_summary(cross_validate(train, estimator, k)).select(F.struct("cv_r2_mean", "cv_r2_std")).scalar()
        row = row.select("*", cv["cv_r2_mean"].alias("cv_r2_mean"), cv["cv_r2_std"].alias("cv_r2_std"))
    return model, row.select(F.lit(name).alias("model"), "*", F.lit(round(seconds, 3)).alias("fit_seconds"))


def _shared_fits(
    regressors: Mapping[str, Estimator], names: Sequence[str], imputer: SQLTransformer | None, rows: DataFrame,
    sets: Sequence[int | None], k: int,
) -> dict[str, list[tuple[PipelineModel, shared_fits.Fit]]]:
    """Pipelines of all regressors for each row set, as ``pipeline`` fits them one by one."""
    for regressor in regressors.values():
        regressor.setParams(labelCol=LABEL, predictionCol=LOG_PREDICTION)
    kernels = {n: kernel_features(names) for n, r in regressors.items() if r.getFeaturesCol() == "kernel"}
    fits = shared_fits.fitted(rows, names, regressors, kernels, sets, k, LABEL, scaler())
    first = [*([imputer] if imputer is not None else []), VectorAssembler(inputCols=list(names), outputCol="assembled")]
    return {n: [(PipelineModel([*first, *f.stages, to_price()]), f) for f in found] for n, found in fits.items()}


def _shared_metrics(rows: DataFrame, names: Sequence[str], fits: Mapping[str, Sequence[shared_fits.Fit]], fold: str | None = None) -> DataFrame:
    """Metrics by model and fold, from one pass over the rows."""
    scored = shared_fits.predictions(rows, names, fits, vocab.TARGET, fold)
    return stage(regression_metrics(scored.withColumn("prediction", F.expm1(LOG_PREDICTION)).groupBy("model", "fold")), "metrics")


def evaluate_together(
    regressors: Mapping[str, Estimator], names: Sequence[str], imputer: SQLTransformer | None, train: DataFrame, test: DataFrame, k: int = 5,
) -> dict[str, tuple[PipelineModel, DataFrame]]:
    """As ``evaluate``, of regressors whose fits for the table and the folds share their passes over the rows.

    The fit seconds are those of all of them.
    """
    filled = (lambda df: imputer.transform(df)) if imputer is not None else (lambda df: df)
    start = time.monotonic()
    fits = _shared_fits(regressors, names, imputer, filled(train), [None, *(range(k) if k > 1 else ())], k if k > 1 else 0)
    seconds = round(time.monotonic() - start, 3)
    tested = _shared_metrics(filled(test), names, {n: [f[0][1]] for n, f in fits.items()}).drop("fold")
    if k > 1:
        cv = cv_summary(_shared_metrics(filled(train), names, {n: [m for _, m in f[1:]] for n, f in fits.items()}, "fold").groupBy("model"))
    out = {}
    for name, found in fits.items():
        # an aggregate over no rows gives a row too
        row = tested.where(F.col("model") == name).agg(*[F.max(c).alias(c) for c in ("mae", "rmse", "r2", "mape")])
        if k > 1:
            mine = cv.where(F.col("model") == name).agg(F.struct(F.max("cv_r2_mean").alias("mean"), F.max("cv_r2_std").alias("std"))).scalar()
            row = row.select("*", mine["mean"].alias("cv_r2_mean"), mine["std"].alias("cv_r2_std"))
        out[name] = found[0][0], row.select(F.lit(name).alias("model"), "*", F.lit(seconds).alias("fit_seconds"))
    return out


def rank_models(rows: Sequence[DataFrame], best: str | None = None) -> DataFrame:
    """Comparison table, best first: by R2, then RMSE, or with a forced best. Flags a low fit."""
    table = reduce(DataFrame.unionByName, rows)
    winner = table.agg(F.min_by("model", F.struct((-F.col("r2")).alias("a"), "rmse"))).scalar()
    chosen = F.lit(best) if best is not None else winner
    digits = {"mae": 2, "rmse": 2, "r2": 4, "mape": 2, "cv_r2_mean": 4, "cv_r2_std": 4}
    table = table.withColumns({"is_best": F.col("model") == chosen, "low_fit": F.col("r2") < vocab.LOW_FIT})
    table = table.withColumns({c: F.round(c, d) for c, d in digits.items() if c in table.columns})
    return table.orderBy(F.desc("r2"), "rmse")


def compare_feature_sets(
    df: DataFrame, sets: Mapping[str, Sequence[str]], models: Mapping[str, Estimator], k: int = 5, seed: int = 42,
    key: str = "listing_id",
) -> DataFrame:
    """Cross-validated metrics of every model on every feature set, best first."""
    folded = stage(with_label(fold_column(df, k, key, shuffle=True, seed=seed)), "folds")
    together = {n: r.copy() for n, r in models.items() if k > 1 and shared_fits.shares_passes(r)}
    rows = []
    for set_name, names in sets.items():
        if together:
            fits = _shared_fits(together, names, None, folded, range(k), k)
            shared = _shared_metrics(folded, names, {n: [m for _, m in f] for n, f in fits.items()}, "fold")
        for model_name, regressor in models.items():
            if model_name in together:
                folds = shared.where(F.col("model") == model_name)
            else:
                folds = stage(cross_validate(folded, pipeline(names, regressor.copy()), k), "metrics")
            rows.append(cv_summary(folds).select(F.lit(set_name).alias("setup"), F.lit(model_name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("cv_r2_mean"), "cv_rmse_mean")
