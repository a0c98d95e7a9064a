"""Statistics of listing tables. Every result is a small table in long form."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions.numeric import round_even
from rentlens.functions.special import t_pvalue
from rentlens.operators.lookup import lookup_join
from rentlens.operators.quantiles import column_quantiles, measures, one_row, quantile_table, quantiles_long

# kernel sums: bins a bandwidth, terms of the series, bandwidths beyond which a kernel is under rounding
_BINS, _TERMS, _REACH = 16, 8, 9


def _rows(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and full-row duplicates (null equals null)."""
    kinds = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kinds"))
    row = lambda name, c: F.struct(F.lit(name).alias("metric"), c.cast("long").alias("value"))
    return _rows(total, [
        row("rows", F.col("rows")),
        row("columns", F.lit(len(df.columns))),
        row("duplicates", F.col("rows") - F.col("kinds")),
    ])


def column_types(df: DataFrame) -> DataFrame:
    """Column names and types, with the number of rows they hold."""
    total = df.agg(F.count("*").alias("rows"))
    return _rows(total, [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("rows")) for c, t in df.dtypes
    ])


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    total = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _rows(total, [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"),
                 F.when(F.col("rows") > 0, F.col(c) * 100.0 / F.col("rows")).alias("pct"))
        for c in columns
    ])


def imputed_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    total = df.agg(*[F.sum(f"{c}_was_missing").alias(c) for c in columns])
    return _rows(total, [F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("imputed")) for c in columns])


def group_stat(df: DataFrame, key: str | Column, value: str, stat: str = "median", name: str | None = None) -> DataFrame:
    """Median, mean, count, min or max of a column by group; groups without a value are left out."""
    key = F.col(key) if isinstance(key, str) else key
    df = df.select(key.alias("key"), F.col(value).alias("value")).where(F.col("value").isNotNull())
    if stat == "median":
        return quantile_table(df, ["key"], {name or "median": ("value", 0.5)})
    agg = {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[stat]
    return df.groupBy("key").agg(agg("value").alias(name or stat))


def value_counts(df: DataFrame, key: str | Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, key: str | Column, digits: int | None = 2) -> DataFrame:
    """Count and share of each value: percent to ``digits`` places, or a fraction if None."""
    counts = value_counts(df, key)
    total = counts.agg(F.sum("n")).scalar()
    if digits is None:
        return counts.withColumn("share", F.col("n") / total)
    return counts.withColumn("pct", round_even(F.col("n") * 100.0 / total, digits))


def frequency_encode(
    df: DataFrame, key: str | Column, name: str = "freq", of: DataFrame | None = None
) -> DataFrame:
    """Attach the share of rows, of ``df`` or of the table ``of``, that have the row's key."""
    key = F.col(key) if isinstance(key, str) else key
    counted = df if of is None else of
    shares = value_shares(counted, key, digits=None).select(F.col("key").alias("freq_key"), F.col("share").alias(name))
    return lookup_join(df.withColumn("freq_key", key), shares, ["freq_key"]).drop("freq_key")


def dominant_value(df: DataFrame, key: str | Column) -> DataFrame:
    """Most frequent value; ties go to the alphabetically first."""
    counts = value_counts(df, key).where(F.col("key").isNotNull())
    best = F.min(F.struct((-F.col("n")).alias("order"), "key", "n")).alias("best")
    return counts.agg(best).select("best.key", "best.n")


def _corrected_skew(n: Column, g1: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def basic_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Everything of ``moments`` that needs no quantile, in one aggregate."""
    n = F.count("v").cast("double")
    return measures(df, [], {c: c for c in columns}).groupBy("measure").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        _corrected_skew(n, F.skewness("v")).alias("skewness"),
        _corrected_kurtosis(n, F.kurtosis("v")).alias("kurtosis"),
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, sample deviation, range, bias-corrected skewness and excess kurtosis.

    ``log_needed`` flags a skewness above 1.
    """
    out = basic_moments(df, columns).join(column_quantiles(df, columns, {"median": 0.5}), "measure", "left")
    return out.withColumn("log_needed", F.col("skewness") > 1)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    quartiles = column_quantiles(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    basic = basic_moments(df, columns).select("measure", "n", "mean", "std", "min", "max")
    return basic.join(quartiles, "measure", "left")


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    long = measures(df, [], {column: column})
    return quantiles_long(long, ["measure"], probs).select("measure", "prob", "quantile")


def range_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return measures(df, [], {c: c for c in columns}).groupBy("measure").agg(
        F.min("v").alias("min"), F.max("v").alias("max")
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form, from one aggregate over all pairs."""
    pairs = list(combinations(columns, 2))
    total = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cell = lambda a, b, r: F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r"))
    rows = [cell(c, c, F.lit(1.0)) for c in columns]
    for a, b in pairs:
        r = F.col(f"`{a}|{b}`")
        rows += [cell(a, b, r), cell(b, a, r)]
    return _rows(total, rows)


def top_correlated(df: DataFrame, columns: Sequence[str], target: str, n: int | None = None) -> DataFrame:
    """Other columns by their correlation with the target, highest first."""
    ranked = correlations(df, columns).where((F.col("x") == target) & (F.col("y") != target))
    ranked = ranked.select(F.col("y").alias("feature"), "r").orderBy(F.desc("r"), "feature")
    return ranked if n is None else ranked.limit(n)


def collinear_pairs(df: DataFrame, columns: Sequence[str], r: float = 0.8) -> DataFrame:
    position = F.array(*[F.lit(c) for c in columns])
    upper = F.array_position(position, F.col("x")) < F.array_position(position, F.col("y"))
    return correlations(df, columns).where(upper & (F.abs("r") > r))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation, number of pairs and t statistic."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = df.agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    rest = F.lit(1.0) - F.col("r") * F.col("r")
    t = F.when(rest > 0, F.col("r") * F.sqrt((F.col("n") - 2) / rest))
    return out.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "r", "n", t.alias("t"))


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """``pearson`` with the two-sided p-value; the function runs on the one aggregated row."""
    return pearson(df, x, y).withColumn("p", t_pvalue(F.col("t"), (F.col("n") - 2).cast("double")))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    ).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "slope", "intercept", "r2")


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of ``v``; the last bin is closed and a constant column has one bin."""
    width = (hi - lo) / bins
    return F.when(width > 0, F.least(F.floor((v - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts between the minimum and the maximum, empty bins included."""
    df = df.where(F.col(column).isNotNull())
    edge = one_row(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    counts = df.select(_bin(F.col(column), edge["lo"], edge["hi"], bins).alias("bin")).groupBy("bin").agg(
        F.count("*").alias("n")
    )
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    width = (edge["hi"] - edge["lo"]) / bins
    return (
        every.join(F.broadcast(counts), "bin", "left")  # at most ``bins`` rows
        .select("bin", (edge["lo"] + width * F.col("bin")).alias("lo"),
                (edge["lo"] + width * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth ``std * n ** (-1/5)``.

    Values are added up in bins of a ``1 / _BINS``-th bandwidth: their number and the powers of their distance
    from the bin's middle. The kernel around each value is the series of these powers around the middle,
    cut where its terms are under the rounding of doubles, so only bins meet grid points, and only those within
    ``_REACH`` bandwidths. A column of one value, or without any, has no density (null).
    """
    df = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    every = df.sparkSession.range(points).select(F.col("id").alias("point"))
    # four numbers, read first so that the plan holds them as literals
    low, high, n, deviation = df.agg(F.min("v"), F.max("v"), F.count("v"), F.stddev("v")).first()
    if not n:
        return every.select("point", F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).where(F.lit(False))
    step = (high - low) / (points - 1)
    x = F.lit(low) + F.lit(step) * F.col("point")
    if not deviation:
        return every.select("point", x.alias("x"), F.lit(None).cast("double").alias("density"))
    width = deviation * n**-0.2
    away = (F.col("v") - low) / width
    cell = F.floor(away * _BINS)
    placed = df.select(cell.alias("cell"), (away - (cell + 0.5) / _BINS).alias("d"))
    bins = placed.groupBy("cell").agg(F.count("*").alias("m0"), *[F.sum(F.pow("d", F.lit(k))).alias(f"m{k}") for k in range(1, _TERMS)])
    middle = (F.col("cell") + 0.5) / _BINS
    first = F.greatest(F.ceil((middle - _REACH) * (width / step)), F.lit(0))
    last = F.least(F.floor((middle + _REACH) * (width / step)), F.lit(points - 1))
    met = bins.withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last))))
    met = met.withColumn("z", F.col("point") * (step / width) - middle)
    z = F.col("z")
    before, here, kernel = F.lit(0.0), F.lit(1.0), F.col("m0")  # Hermite polynomials by their recurrence
    for k in range(1, _TERMS):
        before, here = here, z * here - (k - 1) * before
        kernel = kernel + here * F.col(f"m{k}") / math.factorial(k)
    total = met.groupBy("point").agg(F.sum(F.exp(z * z * -0.5) * kernel).alias("total"))
    scale = n * width * math.sqrt(2 * math.pi)
    # at most ``points`` rows; a point out of reach of all values has density 0
    return every.join(F.broadcast(total), "point", "left").select("point", x.alias("x"), (F.coalesce("total", F.lit(0.0)) / scale).alias("density"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest value within ``k`` IQR) and outlier count by group."""
    keys = list(keys)
    df = df.where(F.col(value).isNotNull())
    quartiles = quantile_table(df, keys, {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)})
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("v").between(F.col("q1") - k * iqr, F.col("q3") + k * iqr)
    return lookup_join(counts, quartiles, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        F.sum("n").alias("n"),
    )


def median_by_pair(df: DataFrame, row: str, column: str | Column, value: str) -> DataFrame:
    column = F.col(column) if isinstance(column, str) else column
    df = df.select(F.col(row).alias("row"), column.alias("column"), F.col(value).alias("value"))
    return quantile_table(df, ["row", "column"], {"median": ("value", 0.5)})


def pivot_median(df: DataFrame, row: str, column: str | Column, value: str, values: Sequence) -> DataFrame:
    """Medians as a grid with one column per entry of ``values``."""
    long = median_by_pair(df, row, column, value)
    grid = long.groupBy("row").pivot("column", list(values)).agg(F.max("median"))
    return grid.toDF("row", *[f"c{v}" for v in values])


def iqr_fences(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    df = df.where(F.col(column).isNotNull())
    fence = quantile_table(df, [], {"q1": (column, 0.25), "q3": (column, 0.75)})
    iqr = F.col("q3") - F.col("q1")
    fence = one_row(fence.select("q1", "q3", iqr.alias("iqr"), (F.col("q1") - k * iqr).alias("lower"),
                                 (F.col("q3") + k * iqr).alias("upper")))
    flagged = df.select(F.col(column).alias("v"), fence.alias("f")).groupBy("f").agg(
        F.count_if((F.col("v") < F.col("f.lower")) | (F.col("v") > F.col("f.upper"))).alias("outliers"),
        F.count("*").alias("n"),
    )
    return flagged.select("f.*", "outliers", (F.col("outliers") * 100.0 / F.col("n")).alias("pct"))


def zscores(df: DataFrame, column: str) -> Column:
    """Distance from the mean in population deviations."""
    center = one_row(df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")))
    return F.when(center["std"] > 0, (F.col(column) - center["mean"]) / center["std"])


def zscore_outliers(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    return df.select(zscores(df, column).alias("z"), F.col(column).alias("v")).agg(
        F.count_if(F.abs("z") > z).alias("outliers"),
        F.when(F.count("*") > 0, F.count_if(F.abs("z") > z) * 100.0 / F.count("*")).alias("pct"),
    )


def band_of(c: Column, edges=vocab.BAND_EDGES) -> Column:
    """Index of the right-open band that holds the value, null outside all bands."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((c >= edges[i]) & (c < edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def price_bands(df: DataFrame, edges=vocab.BAND_EDGES, labels=vocab.BAND_LABELS) -> DataFrame:
    """Listings per price band, empty bands included, in band order."""
    band = band_of(F.col(vocab.TARGET), edges).alias("band")
    counts = df.where(F.col(vocab.TARGET) > 0).groupBy(band).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(x) for x in labels])
    every = df.sparkSession.range(len(labels)).select(F.col("id").cast("int").alias("band"))
    return (
        every.join(F.broadcast(counts), "band", "left")  # at most one row per band
        .select(F.col("band").alias("position"), names[F.col("band")].alias("range"),
                F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("position")
    )


def scatter_bins(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Two-dimensional equal-width counts of every pair of columns: the data of a pair plot."""
    df = df.select(*columns).na.drop()
    edge = one_row(df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]))
    binned = df.select(*[_bin(F.col(c), edge[f"lo_{c}"], edge[f"hi_{c}"], bins).alias(c) for c in columns])
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("x_bin"), F.col(b).alias("y_bin"))
        for a, b in combinations(columns, 2)
    ]
    return binned.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.x", "c.y", "c.x_bin", "c.y_bin").agg(
        F.count("*").alias("n")
    )


def scatter_sample(df: DataFrame, key: str, columns: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a digest of key and seed: the same rows on every run."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.select(key, *columns, digest.alias("digest")).orderBy("digest", key).limit(n).drop("digest")


def top_n(df: DataFrame, by: str, n: int = 10, ascending: bool = False, tie: str = "listing_id") -> DataFrame:
    first = F.asc(by) if ascending else F.desc(by)
    return df.where(F.col(by).isNotNull()).orderBy(first, F.asc(tie)).limit(n)


def segment_share(df: DataFrame, key: str, value: str, column: str) -> DataFrame:
    """Share of rows in one segment and the segment's median."""
    share = one_row(df.agg((F.avg((F.col(key) == value).cast("double")) * 100).alias("share")))
    part = df.where(F.col(key) == value)
    return quantile_table(part, [], {"median": (column, 0.5)}).select(
        F.lit(value).alias("segment"), share["share"].alias("share"), "median"
    )


def anomaly_counts(df: DataFrame, min_bedrooms=15, min_rent=20000, cheap_type="Flat", cheap_rent=100) -> DataFrame:
    rent = F.col(vocab.TARGET)
    return df.agg(
        F.count_if((F.col("bedrooms") >= min_bedrooms) & (rent >= min_rent)).alias("large_and_dear"),
        F.count_if((F.col("property_type") == cheap_type) & (rent <= cheap_rent)).alias("cheap_of_type"),
    )


def round_columns(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating-point column half to even."""
    return df.withColumns({c: round_even(F.col(c), digits) for c, t in df.dtypes if t in ("double", "float")})
