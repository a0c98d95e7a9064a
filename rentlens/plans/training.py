"""Features to fitted and compared models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.operators import ml as M
from rentlens.operators.folds import fold_column, stratified_split
from rentlens.operators.shared_fits import shares_passes
from rentlens.session import stage


@dataclass
class Training:
    models: dict[str, PipelineModel]
    table: DataFrame
    best: str
    test: DataFrame


def split(features: DataFrame, test_share: float = 0.2, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Stored training rows with a fold column, and test rows, both with the log label."""
    marked = stage(stratified_split(features, test_share=test_share), "split")
    train = fold_column(marked.where(~F.col("is_test")), folds)
    return stage(M.with_label(train), "train"), M.with_label(marked.where("is_test"))


def train_models(
    features: DataFrame,
    only: Sequence[str] | None = None,
    best: str | None = None,
    tune: int = 0,
    folds: int = 5,
    names: Sequence[str] = tuple(vocab.MODEL_FEATURES),
    **sizes,
) -> Training:
    """Fit and rank the regressors, cross-validated if ``folds`` is above 1.

    ``tune`` random settings are tried for models with a search space.
    """
    train, test = split(features, folds=max(folds, 2))
    imputer = M.fit_imputer(train, names)
    n, sigma = M.label_figures(train)
    named = {name: r for name, r in M.regressors(n, sigma, **sizes).items() if only is None or name in only}
    for name in named:
        if tune and name in vocab.TUNE_SPACES:
            search = M.random_search(train, names, named[name], vocab.TUNE_SPACES[name], n_iter=tune, imputer=imputer)
            chosen = search.getEstimatorParamMaps()[search.avgMetrics.index(min(search.avgMetrics))]
            named[name] = named[name].copy(chosen)
    together = {name: r for name, r in named.items() if shares_passes(r)}
    found = M.evaluate_together(together, names, imputer, train, test, folds) if together else {}
    for name, regressor in named.items():
        if name not in found:
            found[name] = M.evaluate(name, M.pipeline(names, regressor, imputer), train, test, k=folds)
    models = {name: found[name][0] for name in named}
    measured = stage(reduce(DataFrame.unionByName, [found[name][1] for name in named]), "metrics")
    table = stage(M.rank_models([measured], best), "comparison").orderBy(F.desc("r2"), "rmse")
    winner = table.where("is_best").first()["model"]
    return Training(models, table, winner, test)
