"""Exploratory report over clean listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions.numeric import round_even, safe_ratio
from rentlens.operators import clean as C
from rentlens.operators import stats as S
from rentlens.operators.quantiles import one_row, quantiles_long, scoped_measures
from rentlens.session import stage


def prepare_eda(df: DataFrame) -> DataFrame:
    """Complete rows with derived columns; rows without bedrooms have no room ratio and are dropped."""
    df = C.numeric_columns(C.require_columns(df, vocab.EDA_REQUIRED), [vocab.TARGET, *vocab.STRUCTURAL])
    df = C.drop_missing(df, [vocab.TARGET, *vocab.STRUCTURAL, "property_type"]).where(F.col("size_sqm") > 0)
    df = df.withColumns(
        {
            "log_rent": F.log1p(vocab.TARGET),
            "price_per_sqm": F.col(vocab.TARGET) / F.col("size_sqm"),
            "room_ratio": safe_ratio(F.col("bathrooms"), F.col("bedrooms")),
            "total_rooms": F.col("bedrooms") + F.col("bathrooms"),
        }
    )
    return C.drop_missing(df, ["price_per_sqm", "room_ratio"])


def _long(df: DataFrame, metric: str, key, **values) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f"{metric}.{name}" if name != "value" else metric).alias("metric"),
            key.cast("string").alias("key"), F.col(c).cast("double").alias("value"),
        )
        for name, c in values.items()
    ]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def eda_report(df: DataFrame, segments=("Villa", "Twin Villa")) -> DataFrame:
    """All report figures as ``metric, key, value``.

    All quantiles of the report come from one staged pass over the table, all counts of flagged rows
    from another.
    """
    rent = vocab.TARGET
    bedrooms = round_even(F.col("bedrooms")).cast("int")
    kind, none = F.col("property_type"), F.lit(None).cast("string")
    parts = [("all", none, c, F.col(c)) for c in vocab.EDA_NUMERIC]
    parts += [("type", kind, rent, F.col(rent)), ("type|bedrooms", F.concat_ws("|", kind, bedrooms), rent, F.col(rent))]
    probs = F.when((F.col("scope") == "all") & (F.col("measure") == rent), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    probs = probs.otherwise(F.array(F.lit(0.5)))
    points = stage(quantiles_long(scoped_measures(df, parts), ["scope", "key", "measure"], probs), "points")

    at = lambda p: F.max(F.when((F.col("measure") == rent) & (F.col("prob") == p), F.col("quantile")))
    fence = points.where(F.col("scope") == "all").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fence = fence.withColumns({"iqr": iqr, "lower": F.col("q1") - 1.5 * iqr, "upper": F.col("q3") + 1.5 * iqr})
    edge = one_row(fence)
    z = S.zscores(df, rent)
    counts = df.agg(
        F.count("*").alias("n"),
        F.count_if((F.col(rent) < edge["lower"]) | (F.col(rent) > edge["upper"])).alias("iqr"),
        F.count_if(F.abs(z) > 3).alias("z"),
        *[F.count_if(kind == s).alias(s) for s in segments],
    )
    percent = lambda c: (F.col(c) * 100.0 / F.col("n"))
    counts = counts.withColumns({"iqr_pct": percent("iqr"), "z_pct": percent("z"),
                                 **{f"{s} share": percent(s) for s in segments}})
    counts = stage(counts, "counts")
    by_type = points.where(F.col("scope") == "type")
    correlation = stage(S.correlations(df, vocab.EDA_NUMERIC), "correlations")
    upper = correlation.where((F.col("x") < F.col("y")) & (F.abs("r") > 0.8))
    medians = points.where((F.col("scope") == "all") & (F.col("prob") == 0.5))
    tables = [
        _long(S.basic_moments(df, vocab.EDA_NUMERIC).withColumn("log_needed", F.col("skewness") > 1), "moments",
              F.col("measure"), mean="mean", std="std", min="min", max="max", skewness="skewness",
              kurtosis="kurtosis", log_needed="log_needed"),
        _long(medians, "moments", F.col("measure"), median="quantile"),
        _long(S.value_shares(df, "property_type"), "type", F.col("key"), count="n", percent="pct"),
        _long(by_type, "median_rent_by_type", F.col("key"), value="quantile"),
        _long(S.value_counts(df, bedrooms), "bedroom_count", F.col("key"), value="n"),
        _long(correlation, "correlation", F.concat_ws("|", "x", "y"), value="r"),
        _long(upper, "collinear", F.concat_ws("|", "x", "y"), value="r"),
        _long(points.where(F.col("scope") == "type|bedrooms"), "median_rent", F.col("key"), value="quantile"),
        _long(fence, "iqr", none, q1="q1", q3="q3", iqr="iqr", lower="lower", upper="upper"),
        _long(counts, "iqr", none, outliers="iqr", percent="iqr_pct"),
        _long(counts, "zscore", none, outliers="z", percent="z_pct"),
        *[_long(counts, "segment", F.lit(s), share=f"{s} share") for s in segments],
        _long(by_type.where(F.col("key").isin(*segments)), "segment", F.col("key"), median="quantile"),
        _long(S.anomaly_counts(df), "anomaly", none, large_and_dear="large_and_dear", cheap_of_type="cheap_of_type"),
    ]
    return reduce(DataFrame.unionByName, tables)
