"""Sketched quantiles, the context kept from them, densities from bins and row numbers, against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.operators import context as X
from rentlens.operators import live_context as L
from rentlens.operators import sketches as K
from rentlens.operators import stats as S
from rentlens.operators.ordinals import ordinals, plot_positions


def test_size_and_error_of_a_sketch():
    assert K.rank_error(200) == pytest.approx(0.0165, abs=2e-4)
    for accuracy in (0.2, 0.01, 0.0005):
        k = K.sketch_size(accuracy)
        assert K.rank_error(k) <= accuracy and (k == K.LEAST_K or K.rank_error(k - 1) > accuracy)
    with pytest.raises(ValueError, match="accuracy"):
        K.sketch_size(1e-9)


def test_quantiles_are_within_the_rank_error(spark):
    df = spark.range(200_000).selectExpr("case when id % 10 < 7 then 'hot' when id % 10 = 9 then null else 'k' end as k",
                                         "case when id % 11 = 0 then null else cast(pmod(xxhash64(id), 100003) * (id % 3) as double) end as x")
    probs = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    found = K.quantiles_by_sketch(df, ["k"], probs, "x", accuracy=0.01)
    values = defaultdict(list)
    for k, x in df.where("x is not null").collect():
        values[k].append(x)
    rows = found.collect()
    assert len(rows) == len(probs) * 3
    for r in rows:
        mine = np.sort(values[r.k])
        below, upto = np.searchsorted(mine, r["quantile"], "left") / len(mine), np.searchsorted(mine, r["quantile"], "right") / len(mine)
        assert r.n == len(mine) and below - 0.01 <= r.prob <= upto + 0.01
    gaps = {(r.k, r.prob): r.gap for r in K.rank_gaps(df, found, ["k"], "x").collect()}
    assert len(gaps) == len(rows) and max(gaps.values()) <= 0.01


def test_merged_parts_equal_the_whole_while_all_values_are_held(spark):
    df = spark.range(3000).selectExpr("id % 7 as day", "id % 3 as k", "cast(pmod(xxhash64(id), 997) as double) as x")
    whole = K.quantiles_by_sketch(df, ["k"], [0.1, 0.5], "x", 0.001)
    parts = K.read_quantiles(K.merged(K.sketched(df, ["day", "k"], "x", 0.001), ["k"]), [0.1, 0.5])
    assert sorted(whole.collect()) == sorted(parts.select(whole.columns).collect())
    assert K.quantiles_by_sketch(df.where("x < 0"), [], [0.5], "x").collect() == []


def listings(spark, count, first=0):
    return spark.range(first, first + count).selectExpr(
        "id as listing_id", "concat('district ', id % 5) as district", "element_at(array('Villa', 'Condo', 'House', null), cast(id % 4 + 1 as int)) as property_type",
        "case when id % 50 = 0 then null else exp(5 + pmod(xxhash64(id), 10000) / 3000.0) end as rent_price_usd",
        "case when id % 6 = 0 then null else 20.0 + id % 200 end as size_sqm", "cast(id % 6 as double) as bedrooms", "cast(1 + id % 3 as double) as bathrooms",
        "case when id % 13 = 0 then null else cast(date_add(date '2024-01-01', cast(id % 90 as int)) as string) end as posted_date", "'for rent' as title")


def points(live):
    return {(r.scope, r.key, r.measure, r.prob): (r.group_n, r["quantile"]) for r in live.points.collect()}


def test_refresh_of_two_halves_equals_one_build(spark, tmp_path):
    both, half = str(tmp_path / "both"), str(tmp_path / "half")
    everything = listings(spark, 4000)
    L.start(spark, everything, both, "all", accuracy=0.0005)
    edges, _ = L._settings(spark, both)
    L.start(spark, listings(spark, 2500), half, "one", accuracy=0.0005, edges=edges)
    context = L.refresh(spark, listings(spark, 1500, 2500), half, "two")
    one, two = points(L.market(spark, both)), points(L.market(spark, half))
    assert one == two and len(one) > 30
    L.add(spark, listings(spark, 1500, 2500), half, "two")  # the same batch once more
    assert points(L.market(spark, half)) == one
    # against the exact context: counts of kept rows, medians between the neighbours of the exact ones
    live = L.market(spark, half)
    rows = X.market_rows(everything).where((F.col("rent") >= live.low) & (F.col("rent") < live.high))
    exact = {(r.scope, r.key, r.measure, r.prob): r for r in X.market_points(rows).collect()}
    assert set(exact) == set(two)
    assert all(r.group_n == two[k][0] for k, r in exact.items())
    assert two["all", None, "rent", 0.5][1] == pytest.approx(exact["all", None, "rent", 0.5]["quantile"], rel=0.002)
    assert abs(live.low_rank - L.LOW) <= 0.002 and abs(live.high_rank - L.HIGH) <= 0.002
    assert set(context.tables) == set(X.TABLES) and context.overall["overall_price"] == two["all", None, "rent", 0.5][1]


def test_days_of_a_live_context_and_drifted_tails(spark, tmp_path):
    path = str(tmp_path / "days")
    L.start(spark, listings(spark, 3000), path, "one", accuracy=0.001)
    recent = L.market(spark, path, since="2024-02-01", max_drift=0.5)
    dated = listings(spark, 3000).where("posted_date >= '2024-02-01' and rent_price_usd > 0").where((F.col("rent_price_usd") >= recent.low) & (F.col("rent_price_usd") < recent.high))
    assert points(recent)["all", None, "rent", 0.5][0] == dated.count()
    dear = listings(spark, 3000, 50_000).withColumn("rent_price_usd", F.col("rent_price_usd") * 40)
    L.add(spark, dear, path, "two")
    with pytest.raises(L.DriftedEdges):
        L.market(spark, path)


def test_live_context_of_no_listings(spark, tmp_path):
    path = str(tmp_path / "none")
    L.start(spark, listings(spark, 10).where("listing_id < 0"), path, "one")
    figures = L.market(spark, path).context().overall
    assert all(figures[k] == v for k, v in vocab.CONTEXT_DEFAULTS.items())


@pytest.mark.parametrize("values", [
    [float(i % 37) ** 2 for i in range(500)], [0.0] * 50 + [1e6], [1.0, 2.0], np.random.default_rng(1).lognormal(3, 2, 400).tolist(), [None, 5.0, 7.5, None, -3.0],
], ids=["squares", "outlier", "two", "long tail", "nulls"])
def test_density_equals_kernel_sums(spark, values):
    got = sorted(S.density(spark.createDataFrame([(v,) for v in values], "v double"), "v", 60).collect())
    v = np.array([x for x in values if x is not None])
    width = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 60)
    want = np.exp(-0.5 * ((grid[:, None] - v) / width) ** 2).sum(1) / (len(v) * width * np.sqrt(2 * np.pi))
    assert [r.point for r in got] == list(range(60))
    assert np.allclose([r.x for r in got], grid) and np.allclose([r.density for r in got], want, rtol=1e-9, atol=1e-15 / width)


def test_density_without_spread(spark):
    assert S.density(spark.createDataFrame([(None,)], "v double"), "v").collect() == []
    assert {r.density for r in S.density(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()} == {None}


def test_density_bins_before_it_meets_the_grid(spark):
    plan = S.density(spark.range(1000).selectExpr("cast(id as double) as v"), "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1
    assert "Aggregate [cell" in plan[plan.index("Generate"):]  # what is multiplied is binned


def test_ordinals_of_hot_keys_and_equal_rows(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["hot"] * 8 + ["b", None, "z"]), draw.randint(0, 3), i // 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x int, ordinal int").repartition(5)
    got = ordinals(df, [F.col("k").asc_nulls_last(), F.desc("x")])
    assert got.columns == ["k", "x", "ordinal"]
    found = sorted(got.collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in found] == list(range(2000))
    assert [(r.k, r.x) for r in found] == sorted(((k, x) for k, x, _ in rows), key=lambda r: (r[0] is None, r[0] or "", -r[1]))
    assert ordinals(df.where("x > 9"), ["k"]).collect() == []


def test_plot_positions(spark):
    df = spark.createDataFrame([(i, 1000.0 if i == 7 else float(i % 3)) for i in range(40)], "id long, v double")
    got = sorted(plot_positions(df, "v", ["id"]).collect(), key=lambda r: r.ordinal)
    assert [(r.id, r.ordinal, r.outlier) for r in got] == [(i, i, i == 7) for i in range(40)]


def test_ordinal_plan_gathers_only_counts(spark):
    plan = ordinals(spark.range(100).toDF("id"), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert window.index("Aggregate") < window.index("Relation")
