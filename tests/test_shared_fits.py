"""Fits that share their passes against pipelines fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.operators import ml as M
from rentlens.operators import shared_fits as S
from rentlens.operators import support_vectors as V
from rentlens.operators.folds import fold_column

NAMES = ["a", "b", "both", "same", "flag", "large"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 40, 700), draw.normal(3, 2, 700)
    flag = (draw.random(700) < 0.2).astype(float)
    rent = np.round(np.exp(5 + 0.03 * a + 0.1 * b + 0.4 * flag + draw.normal(0, 0.3, 700)), 2)
    values = [(i, float(p), float(q), float(p + q), 0.1, float(f), 1e6 + float(p * p), float(r)) for i, (p, q, f, r) in enumerate(zip(a, b, flag, rent))]
    df = spark.createDataFrame(values, ["listing_id", *NAMES, "rent_price_usd"]).coalesce(2)
    return M.with_label(fold_column(df, 3)).cache()


def _sharing(rows):
    n, sigma = M.label_figures(rows)
    named = {name: r for name, r in M.regressors(n, sigma).items() if S.shares_passes(r)}
    return named | {"Support Vector Regression": V.SupportVectorRegression(featuresCol="kernel", c=1.0, epsilon=0.3)}


def test_shared_fits_equal_fits_one_by_one(rows):
    named = _sharing(rows)
    assert list(named) == ["Ridge Regression", "ElasticNet", "Support Vector Regression"]
    shared = M._shared_fits(named, NAMES, None, rows, [None, 1], 3)
    for name in named:
        alone = _sharing(rows)[name]
        for left_out, (model, fit) in zip([None, 1], shared[name]):
            part = rows if left_out is None else rows.where(F.col("fold") != left_out)
            want = M.pipeline(NAMES, alone.copy()).fit(part)
            x = np.array(rows.select(*NAMES).sort("listing_id").collect(), float)
            read = lambda m: np.array([r[0] for r in m.transform(rows).sort("listing_id").select(M.LOG_PREDICTION).collect()])
            expected = read(want)
            assert np.allclose(read(model), expected, atol=1e-5, rtol=0), (name, left_out)
            assert np.allclose(fit.predicted(x), read(model), atol=1e-9, rtol=0), (name, left_out)


def test_metrics_equal_those_of_each_model(rows):
    train, test = rows.where("fold < 2"), rows.where("fold = 2")
    named = {n: r for n, r in _sharing(rows).items() if n in ("Ridge Regression", "ElasticNet")}
    found = M.evaluate_together(named, NAMES, None, train, test, k=2)
    for name, (_, row) in found.items():
        _, want = M.evaluate(name, M.pipeline(NAMES, _sharing(rows)[name]), train, test, k=2)
        got, want = row.first().asDict(), want.first().asDict()
        assert list(got) == list(want) and got.pop("fit_seconds") > 0 and want.pop("fit_seconds") > 0
        assert got.pop("model") == want.pop("model") == name
        assert got == pytest.approx(want, rel=1e-4), name


def test_no_test_rows_give_a_row_without_metrics(rows):
    named = {n: r for n, r in _sharing(rows).items() if n == "Ridge Regression"}
    row = M.evaluate_together(named, NAMES, None, rows, rows.where("fold > 7"), k=1)["Ridge Regression"][1].first()
    assert row["model"] == "Ridge Regression" and row["mae"] is None and row["r2"] is None


def test_passes_are_those_of_the_longest_fit(rows, monkeypatch):
    passes = []
    real = V.added
    monkeypatch.setattr(S, "added", lambda *a: passes.append(1) or real(*a))

    def needed(sets):
        passes.clear()
        M._shared_fits({"svr": _sharing(rows)["Support Vector Regression"]}, NAMES, None, rows, sets, 3)
        return len(passes)

    assert needed([None, 0]) == max(needed([None]), needed([0]))


def test_gaps_are_an_error(rows):
    odd = rows.withColumn("a", F.when(F.col("listing_id") != 5, F.col("a")))
    with pytest.raises(Exception, match="a feature is null"):
        M._shared_fits(_sharing(rows), NAMES, None, odd, [None], 0)


def test_cosines():
    z = np.random.default_rng(1).normal(0, 30, (100, 7))
    assert np.abs(S.cosines(z.copy()) - np.cos(z)).max() < 1e-13
