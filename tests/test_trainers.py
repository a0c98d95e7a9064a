"""Tree and support-vector trainers against plain Python."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rentlens.operators import boosting as H
from rentlens.operators import ml as M
from rentlens.operators import random_trees as R
from rentlens.operators import support_vectors as V


def frame(spark, x, y):
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double")
    return rows.repartition(3).withColumn("features", array_to_vector("x"))


def sample(count=240, seed=0):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.integers(0, 30, count), draw.integers(0, 4, count), np.round(draw.normal(0, 5, count), 1)]).astype(float)
    y = 8 * x[:, 0] + 40 * (x[:, 1] > 1) + draw.integers(-20, 20, count) * (x[:, 2] > 0)
    return x, np.round(y)


def best_first(x, residual, leaves, least, l2, deepest):
    """Tree grown leaf by leaf: list of (rows, value), thresholds are values of the data."""
    def split(rows, depth):
        g, best = -residual[rows], None
        if len(rows) < 2 * least or (deepest and depth >= deepest):
            return None
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                left = x[rows, j] <= cut
                n, m = left.sum(), (~left).sum()
                if n < least or m < least:
                    continue
                gain = g[left].sum() ** 2 / (n + l2) + g[~left].sum() ** 2 / (m + l2) - g.sum() ** 2 / (len(rows) + l2)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, cut, rows[left], rows[~left], depth + 1)
        return best

    everything = np.arange(len(x))
    open_leaves = [(everything, split(everything, 0))]
    while len(open_leaves) < leaves:
        able = [i for i, (_, s) in enumerate(open_leaves) if s]
        if not able:
            break
        i = max(able, key=lambda i: open_leaves[i][1][0])
        _, (_, _, _, left, right, depth) = open_leaves.pop(i)
        open_leaves += [(left, split(left, depth)), (right, split(right, depth))]
    return [(rows, residual[rows].sum() / (len(rows) + l2)) for rows, _ in open_leaves]


@pytest.mark.parametrize("leaves, least, l2, deepest", [(6, 5, 0.0, 0), (31, 3, 1.5, 0), (10, 1, 0.5, 2)])
def test_boosting_equals_trees_grown_leaf_by_leaf(spark, leaves, least, l2, deepest):
    x, y = sample()
    booster = H.HistogramBoosting(maxIter=4, stepSize=0.3, maxLeaves=leaves, minInstancesPerNode=least, l2=l2, maxDepth=deepest)
    model = booster.fit(frame(spark, x, y))
    want = np.full(len(y), y.mean())
    for _ in range(4):
        for rows, value in best_first(x, y - want, leaves, least, l2, deepest):
            want[rows] += 0.3 * value
    got = 0.3 * model.trees.sums(x) + model.base
    assert np.allclose(got, want, atol=1e-6)


def test_boosting_carries_predictions_and_bins_many_values(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 3))
    y = 3 * x[:, 0] + np.sin(3 * x[:, 1]) + (x[:, 2] > 0.3)
    df = frame(spark, x, y)
    model = H.HistogramBoosting(maxIter=23, stepSize=0.2, maxLeaves=8).fit(df)
    assert len(model.trees.roots) == 23
    got = model.transform(df).select("x", "label", "prediction").toPandas()
    left = ((got.label - got.prediction) ** 2).mean() / got.label.var()
    assert left < 0.03
    assert np.allclose(got.prediction, 0.2 * model.trees.sums(np.stack(got.x)) + model.base)
    # each tree's leaves hold the mean of what the trees before leave
    before = model.base + np.zeros(len(x))
    for t in range(23):
        leaf = model.trees.leaves(x, t)
        for node in np.unique(leaf):
            assert model.trees.number[node] == pytest.approx((y - before)[leaf == node].mean(), abs=1e-9)
        before += 0.2 * model.trees.number[leaf]


def test_bins_hold_even_shares(spark):
    x = np.column_stack([np.arange(5000.0), np.arange(5000) % 7, np.repeat([0.0, 1.0], 2500)])
    rows = spark.createDataFrame([(a.tolist(),) for a in x], "x array<double>")
    many, few, two = H.bin_edges(rows, 3, 50, 0.001)
    assert np.abs(np.searchsorted(np.arange(5000.0), many, "right") / 5000 - np.arange(1, 50) / 50).max() <= 0.002
    assert few.tolist() == [0, 1, 2, 3, 4, 5] and two.tolist() == [0.0]


def random_tree(x, y, key, depth, least, split, deepest, features):
    """Mean of each row's leaf."""
    low, high = x.min(0), x.max(0)
    cut = R.thresholds(key, low, high)
    allowed, best = R._subset(key, x.shape[1], features), None
    if len(y) >= max(split, 2 * least) and len(set(y)) > 1 and (not deepest or depth < deepest):
        for j in range(x.shape[1]):
            left = x[:, j] <= cut[j]
            if allowed[j] and low[j] < high[j] and least <= left.sum() <= len(y) - least:
                gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum()
                if best is None or gain > best[0]:
                    best = (gain, left)
    if best is None:
        return np.full(len(y), y.mean())
    out = np.zeros(len(y))
    for side, mine in enumerate((best[1], ~best[1])):
        out[mine] = random_tree(x[mine], y[mine], R.child_key(key, side), depth + 1, least, split, deepest, features)
    return out


@pytest.mark.parametrize("local", [10, 60, 100_000])
@pytest.mark.parametrize("limits", [(1, 2, 0, "all"), (3, 8, 4, "0.7")])
def test_extra_trees_equal_plain_recursion(spark, local, limits):
    x, y = sample(150, 3)
    least, split, deepest, features = limits
    trainer = R.ExtraTrees(numTrees=5, maxDepth=deepest, minInstancesPerNode=least, minSplit=split, featureSubsetStrategy=features, seed=9, localRows=local)
    model = trainer.fit(frame(spark, x, y))
    trees = [random_tree(x, y, R.root_key(9, t)[()], 0, least, split, deepest, trainer.features(3)) for t in range(5)]
    assert np.allclose(model.trees.sums(x) / 5, np.mean(trees, axis=0))
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_draws_are_even_and_differ():
    keys = R.root_key(1, np.arange(2000))
    u = R.draws(keys, 5)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and len(np.unique(u)) == u.size
    assert len({int(k) for k in keys} | {int(k) for s in (0, 1) for k in R.child_key(keys, s)}) == 6000
    assert (R._subset(keys, 10, 3).sum(1) == 3).all()


def test_support_vectors_reach_the_least_objective(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(400, 6))
    y = x @ np.array([1.0, -2.0, 0.0, 0.5, 0.0, 3.0]) + 7 + draw.standard_t(2, 400)
    c, epsilon = 5.0, 0.3
    objective = lambda w: (w[:-1] ** 2).sum() / 2 + c * np.maximum(np.abs(y - x @ w[:-1] - w[-1]) - epsilon, 0).sum()
    model = V.SupportVectorRegression(c=c, epsilon=epsilon).fit(frame(spark, x, y))
    got = objective(np.append(model.getOrDefault(model.weights), model.getOrDefault(model.intercept)))
    # plain subgradient steps of falling length, the best point kept
    w, best = np.append(np.zeros(6), y.mean()), np.inf
    ones = np.hstack([x, np.ones((400, 1))])
    for t in range(1, 30_000):
        r = y - ones @ w
        slope = -(c * (np.sign(r) * (np.abs(r) > epsilon)) @ ones) + np.append(w[:-1], 0)
        w = w - 0.5 / t**0.75 * slope / 400
        best = min(best, objective(w))
    assert got <= 1.002 * best
    predicted = model.transform(frame(spark, x, y)).select("x", "prediction").collect()
    weights = np.array(model.getOrDefault(model.weights))
    assert all(r.prediction == pytest.approx(np.array(r.x) @ weights + model.getOrDefault(model.intercept)) for r in predicted)


def test_corner_of_the_loss():
    r = np.array([-5.0, -1.0, 0.0, 0.9, 1.0, 1.1, 1.2, 3.0])
    exact = np.maximum(np.abs(r) - 1, 0)
    for width in (0.5, 0.1, 0.001):
        smooth = V._loss(r, 1.0, width)
        assert (smooth <= exact + 1e-12).all() and (smooth >= exact - width - 1e-12).all()


@pytest.mark.parametrize("trainer", [H.HistogramBoosting(maxIter=2, maxLeaves=4), R.ExtraTrees(numTrees=3), V.SupportVectorRegression(c=1.0)], ids=lambda t: type(t).__name__)
def test_models_are_stored_and_no_rows_give_a_model(spark, trainer, tmp_path):
    x, y = sample(100)
    df = frame(spark, x, y)
    model = Pipeline(stages=[trainer]).fit(df)
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    pick = lambda m: sorted(m.transform(df).select("label", "prediction").collect())
    assert pick(again) == pick(model)
    none = trainer.fit(df.where("label is null"))
    assert {r.prediction for r in none.transform(df).select("prediction").collect()} == {0.0}


def test_trainers_in_pipelines_and_searches(spark):
    x, y = sample(200, 8)
    df = frame(spark, x, np.abs(y) + 1).select(F.monotonically_increasing_id().alias("listing_id"), F.col("x")[0].alias("a"), F.col("x")[2].alias("b"), F.col("label").alias("rent_price_usd"))
    named = M.regressors(200, 1.0, trees=4, rounds=3)
    for name in ("Extra Trees", "Support Vector Regression", "Histogram Gradient Boosting"):
        fitted = M.pipeline(["a", "b"], named[name]).fit(M.with_label(df))
        assert fitted.transform(df).where("prediction is null").count() == 0
    search = M.random_search(df, ["a", "b"], named["Histogram Gradient Boosting"], {"maxIter": [1], "maxLeaves": [2, 8]}, folds=2)
    tried = {frozenset(m.values()): error for m, error in zip(search.getEstimatorParamMaps(), search.avgMetrics, strict=True)}
    assert tried[frozenset({1, 8})] < tried[frozenset({1, 2})]


def test_every_tuned_setting_is_a_parameter():
    from rentlens import vocab

    named = M.regressors(10, 1.0)
    for name, space in vocab.TUNE_SPACES.items():
        for parameter, values in space.items():
            for value in values:
                named[name].copy({named[name].getParam(parameter): value})
