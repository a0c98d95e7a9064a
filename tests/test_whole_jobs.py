"""Registered model comparisons run at their published sizes."""

import inspect

from rentlens import vocab
from rentlens.catalog import modelling
from rentlens.operators import ml as M
from rentlens.plans import training


def _asked(monkeypatch, holder, name, answer):
    """Arguments of the next call of a function, which gives ``answer`` instead of doing its work."""
    signature, asked = inspect.signature(getattr(holder, name)), {}

    def call(*args, **values):
        bound = signature.bind(*args, **values)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return answer

    monkeypatch.setattr(holder, name, call)
    return asked


def test_feature_sets_are_compared_by_all_models_at_full_size(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 100.0 + i) for i in range(20)], "listing_id long, rent_price_usd double")
    monkeypatch.setattr(modelling.B, "features", lambda *_: rows)
    asked = _asked(monkeypatch, M, "compare_feature_sets", rows)
    modelling.compare_feature_sets(spark, "nowhere")
    assert asked["k"] == 5 and asked["df"] is rows
    assert asked["sets"] == {"baseline": vocab.BASELINE_FEATURES, "engineered": vocab.COMPARISON_FEATURES}
    models = asked["models"]
    assert list(models) == ["Ridge", "RandomForest", "HistGradientBoosting", "SVR"]
    forest, boosted, vectors = (models[n] for n in list(models)[1:])
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getFeatureSubsetStrategy()) == (500, 14, 2, "all")
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getOrDefault(boosted.maxDepth)) == (500, 0.05, 8)
    assert (vectors.getOrDefault(vectors.c), vectors.getOrDefault(vectors.epsilon)) == (80.0, 0.06)


def test_all_models_are_compared_at_full_size(spark, monkeypatch):
    rows = spark.range(3)
    monkeypatch.setattr(modelling.B, "features", lambda *_: rows)
    asked = _asked(monkeypatch, modelling, "train_models", training.Training({}, rows, "", rows))
    modelling.compare_models(spark, "nowhere")
    assert asked["features"] is rows and asked["only"] is None and asked["folds"] == 5
    named = M.regressors(100, 1.0, **asked.get("sizes", {}))
    assert len(named) == 8
    assert (named["Random Forest"].getNumTrees(), named["Random Forest"].getMaxDepth()) == (400, 30)
    extra = named["Extra Trees"]
    assert (extra.getOrDefault(extra.numTrees), extra.getOrDefault(extra.maxDepth)) == (500, 0)
    assert (named["Gradient Boosting"].getMaxIter(), named["Gradient Boosting"].getMaxDepth()) == (100, 3)
    assert named["Histogram Gradient Boosting"].getMaxIter() == 100
