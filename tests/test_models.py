"""Regressors, search and persistence."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression

from rentlens.catalog import shared as B
from rentlens.operators import ml as M
from rentlens.plans.training import split
from rentlens.sources.tables import load_model, save_model

NAMES = ["size_sqm", "bedrooms", "bathrooms"]


@pytest.fixture(scope="module")
def rows(spark, small):
    return M.with_label(B.features(spark, small)).cache()


def test_ridge_equals_the_closed_form(rows):
    n, sigma = M.label_figures(rows)
    model = M.pipeline(NAMES, M.ridge(n, sigma, 30.0)).fit(rows)
    pdf = rows.select(*NAMES, M.LABEL).toPandas()
    x = ((pdf[NAMES] - pdf[NAMES].mean()) / pdf[NAMES].std()).to_numpy()
    y = pdf[M.LABEL].to_numpy()
    want = np.linalg.solve(x.T @ x + 30.0 * np.eye(3), x.T @ (y - y.mean()))
    assert np.allclose(model.stages[-2].coefficients.toArray(), want, atol=1e-5)


def test_imputer_uses_exact_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None)], "a double, b double")
    filled = M.fit_imputer(df, ["a", "b"]).transform(df).collect()
    assert filled[-1]["a"] == 2.5 and all(r["b"] == 0.0 for r in filled)


def test_kernel_features_approach_the_kernel(spark):
    from pyspark.ml.linalg import Vectors

    points = [Vectors.dense(0.1, 0.2), Vectors.dense(0.4, -0.3)]
    df = spark.createDataFrame([(p,) for p in points], ["f"])
    stage = M.FourierFeatures(inputCol="f", outputCol="k", size=4000, gamma=0.5, inputs=2)
    a, b = (r["k"].toArray() for r in stage.transform(df).collect())
    assert a @ b == pytest.approx(np.exp(-0.5 * Vectors.squared_distance(*points)), abs=0.05)


def test_search_settings_are_distinct_and_stable():
    from rentlens import vocab

    for space in vocab.TUNE_SPACES.values():
        settings = M.draw_settings(space)
        assert settings == M.draw_settings(space) and len({str(s) for s in settings}) == min(12, len(settings))
    assert len(M.draw_settings({"a": [1, 2]})) == 2


def test_search_picks_the_lowest_error(rows):
    search = M.random_search(rows.drop(M.LABEL), NAMES, GBTRegressor(seed=1, maxDepth=2), {"maxIter": [1, 3]}, folds=2)
    best = search.avgMetrics.index(min(search.avgMetrics))
    assert search.bestModel.stages[-2].getNumTrees == [1, 3][best]


def test_split_is_disjoint(spark, small):
    train, test = split(B.features(spark, small))
    both = train.select("listing_id").intersect(test.select("listing_id"))
    assert both.count() == 0 and train.count() + test.count() == B.features(spark, small).count()
    assert train.groupBy("fold").count().count() == 5


def test_model_round_trip(spark, rows, tmp_path):
    model = M.pipeline(NAMES, LinearRegression(), M.fit_imputer(rows, NAMES)).fit(rows)
    save_model(model, str(tmp_path), "v1")
    again = load_model(spark, str(tmp_path), "v1")
    pick = lambda m: [r["prediction"] for r in m.transform(rows).sort("listing_id").select("prediction").limit(20).collect()]
    assert pick(model) == pick(again)
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path), "v2")


def test_ranking_and_forced_best(rows):
    kinds = {"Linear Regression": LinearRegression(), "Boosted": GBTRegressor(maxIter=2, maxDepth=2, seed=1)}
    parts = [M.evaluate(n, M.pipeline(NAMES, r), rows, rows, k=1)[1] for n, r in kinds.items()]
    table = M.rank_models(parts).collect()
    assert table[0]["r2"] >= table[1]["r2"] and [r["is_best"] for r in table] == [True, False]
    forced = {r["model"]: r["is_best"] for r in M.rank_models(parts, "Linear Regression").collect()}
    assert forced == {"Linear Regression": True, "Boosted": False}


def test_importances_sum_to_one(rows):
    model = M.pipeline(NAMES, GBTRegressor(maxIter=2, maxDepth=3, seed=1)).fit(rows)
    pairs = M.importances(model, NAMES)
    assert sum(v for _, v in pairs) == pytest.approx(1.0) and pairs == sorted(pairs, key=lambda p: -p[1])


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 330.0)], "rent_price_usd double, prediction double")
    row = M.regression_metrics(df).first()
    assert row["mae"] == pytest.approx(50 / 3) and row["mape"] == pytest.approx((10 + 5 + 10) / 3)
    assert row["r2"] == pytest.approx(1 - 1100 / 20000) and row["rmse"] == pytest.approx((1100 / 3) ** 0.5)


def _jobs_of(spark, group, work):
    """What ``work`` gives, and the number of Spark jobs it ran."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_penalised_lines_need_few_passes(spark):
    """Penalised lines come from sums over the rows, whose passes do not grow with the steps of the solver."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 4)) @ draw.normal(size=(4, 4)) + 3.0
    y = x @ np.array([0.5, -0.2, 0.0, 0.1]) + draw.normal(size=400)
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], names + [M.LABEL]).cache()
    rows.count()
    sigma = float(y.std(ddof=1))
    scaled = (x - x.mean(0)) / x.std(0, ddof=1)
    ridge, jobs = _jobs_of(spark, "ridge", lambda: M.pipeline(names, M.ridge(400, sigma)).fit(rows))
    assert jobs <= 10
    expected = np.linalg.solve(scaled.T @ scaled + 3.0 * np.eye(4), scaled.T @ (y - y.mean()))
    assert np.allclose(ridge.stages[-2].coefficients.toArray(), expected, rtol=1e-7)
    net, jobs = _jobs_of(spark, "net", lambda: M.pipeline(names, M.elastic_net(sigma)).fit(rows))
    assert jobs <= 10
    w = net.stages[-2].coefficients.toArray()
    pull = scaled.T @ (y - y.mean() - scaled @ w) / 400 - 0.03 * 0.8 * w
    assert np.allclose(pull[w != 0], 0.03 * 0.2 * np.sign(w[w != 0]), atol=1e-4) and (abs(pull[w == 0]) <= 0.03 * 0.2 + 1e-4).all()
