"""Order statistics, imputation, folds and splits against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rentlens.operators import clean as C
from rentlens.operators import folds as D
from rentlens.operators import stats as S
from rentlens.operators.lookup import lookup_join
from rentlens.operators.quantiles import measures, order_statistics, quantile_table, quantiles_long

numbers = st.one_of(st.none(), st.floats(-1e9, 1e9), st.integers(-3, 3).map(float), st.sampled_from([0.0, -0.0, 1e-300, 1e300]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), numbers), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r["k"], r["prob"]): r["quantile"]
           for r in quantiles_long(measures(df, ["k"], {"x": "x"}), ["k"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for key in ("a", "b", None):
        mine = [v for k, v in rows if k == key and v is not None]
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            if mine:
                want = np.quantile(mine, p)
                assert abs(got[key, p] - want) <= 1e-9 * max(1.0, abs(want))
            else:
                assert (key, p) not in got


def test_hot_group_and_copies(spark):
    """A group with most rows, a third of them equal."""
    df = spark.range(60000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 3 == 0, 500.0).otherwise((F.col("id") * 7919 % 100003) / 7.0).alias("x"))
    pdf = df.toPandas()
    got = quantile_table(df, ["k"], {"q1": ("x", 0.25), "m": ("x", 0.5), "p99": ("x", 0.99)}).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["x"].quantile([0.25, 0.5, 0.99]).unstack()
    assert np.allclose(got[["q1", "m", "p99"]].to_numpy(), want.loc[got.index].to_numpy())


def test_imputation(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), ("b", None), (None, 10.0), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, x double")
    got = [r["x"] for r in C.impute_median(df, ["x"], by="k").sort("i").collect()]
    assert got == [1.0, 2.0, 1.5, 2.0, 10.0, 10.0]


def test_shuffled_lookup_equals_broadcast(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("k"))
    table = spark.createDataFrame([(0, "x"), (1, "y"), (None, "n")], "k long, v string")
    shuffled = lookup_join(facts, table, ["k"], small=False)
    assert sorted(shuffled.collect()) == sorted(lookup_join(facts, table, ["k"]).collect())


def test_contiguous_folds_equal_ntile(spark):
    df = spark.range(13).select((F.col("id") * 37 + 5).alias("listing_id"))
    sizes = D.fold_column(df, 5).groupBy("fold").count().sort("fold").collect()
    assert [tuple(r) for r in sizes] == [(0, 3), (1, 3), (2, 3), (3, 2), (4, 2)]
    few = D.fold_column(df.limit(2), 5)
    assert sorted(r["fold"] for r in few.collect()) == [0, 1]


def test_strata_equal_qcut(spark):
    y = np.random.default_rng(1).choice([100.0, 100.0, 250.0, 300.0, 777.0, 900.0, 1000.0], 500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "listing_id long, rent_price_usd double")
    edges = D.strata_edges(df).scalar()
    got = [r[0] for r in df.select(D.stratum(F.col("rent_price_usd"), edges).alias("s"), "listing_id").sort("listing_id").collect()]
    want = pd.qcut(y, 10, duplicates="drop", labels=False)
    assert got == list(want)


def test_split_is_stratified_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("listing_id"), (F.col("id") * 13 % 997).cast("double").alias("rent_price_usd"))
    split = D.stratified_split(df)
    per = split.groupBy("stratum").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert len(per) == 10 and all(r["t"] == round(0.2 * r["n"]) for r in per)
    again = D.stratified_split(df.repartition(7))
    assert sorted(split.where("is_test").select("listing_id").collect()) == sorted(again.where("is_test").select("listing_id").collect())


def test_density_equals_the_sum_of_kernels(spark):
    x = np.round(np.random.default_rng(4).normal(size=300), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    points = S.density(df, "x", 50).toPandas().sort_values("point")
    grid, width = np.linspace(x.min(), x.max(), 50), x.std(ddof=1) * len(x) ** -0.2
    kernels = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / width) ** 2)
    assert np.allclose(points["x"], grid)
    assert np.allclose(points["density"], kernels.sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi)))


def test_histogram_of_a_constant(spark):
    rows = S.histogram(spark.range(7).select(F.lit(3.0).alias("x")), "x", 5).collect()
    assert {r["bin"]: r["n"] for r in rows} == {0: 7, 1: 0, 2: 0, 3: 0, 4: 0}


def test_corrected_moments(spark):
    x = pd.Series(np.random.default_rng(2).lognormal(size=300))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    row = S.moments(df, ["x"]).first()
    assert np.isclose(row["skewness"], x.skew()) and np.isclose(row["kurtosis"], x.kurt()) and row["log_needed"]


@pytest.mark.parametrize("kind", ["clustered", "integers", "texts", "far"])
def test_ranks_in_crowded_buckets(spark, kind):
    """Values that share a first bucket, so that histograms are refined several times."""
    value = {
        "clustered": F.lit(1.7e9) + F.col("id") * 7919 % 20011 / 1000.0,
        "integers": F.lit(9_000_000_000_000_000_000) + F.col("id") * 7919 % 20011,
        "texts": F.concat(F.lit("listing-2024-"), F.lpad((F.col("id") * 7919 % 20011).cast("string"), 6, "0")),
        "far": F.when(F.col("id") == 3, F.lit(-(2**62))).otherwise(F.col("id") * 7919 % 20011),
    }[kind]
    df = spark.range(20000).select(value.alias("x"))
    wanted = F.array(*[F.struct(F.lit(i).alias("label"), F.lit(r).alias("rank")) for i, r in enumerate((0, 1, 777, 10000, 19999))])
    got = {r["rank"]: r["v"] for r in order_statistics(df, [], wanted, "x", limit=50).collect()}
    want = sorted(r.x for r in df.collect())
    assert got == {r: want[r] for r in (0, 1, 777, 10000, 19999)}


@pytest.mark.parametrize("key", ["listing_id", "text", "digest"])
def test_contiguous_folds_of_any_id(spark, key):
    df = spark.range(1189).select(
        F.when(F.col("id") == 9, F.lit(10**17)).otherwise(F.col("id")).alias("listing_id"), F.concat(F.lit("site:"), F.col("id")).alias("text"),
        F.md5(F.col("id").cast("string").cast("binary")).alias("digest"))
    rows = D.fold_column(df, 5, key).select(key, "fold").collect()
    ordered = [r.fold for r in sorted(rows, key=lambda r: r[0])]
    assert ordered == sorted(ordered)
    assert [ordered.count(f) for f in range(5)] == [238, 238, 238, 238, 237]
