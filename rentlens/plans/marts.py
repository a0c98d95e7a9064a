"""Dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions.numeric import round_even
from rentlens.operators.stats import price_bands


def _mean_rent(df: DataFrame, key: str, name: str) -> DataFrame:
    priced = df.where((F.col(vocab.TARGET) > 0) & F.col(key).isNotNull())
    return priced.groupBy(F.col(key).alias(name)).agg(round_even(F.avg(vocab.TARGET)).alias("avg_price"))


def mean_rent_by_district(df: DataFrame, n: int = 8) -> DataFrame:
    return _mean_rent(df, "district", "location").orderBy(F.desc("avg_price"), "location").limit(n)


def mean_rent_by_bedrooms(df: DataFrame, most: int = 8) -> DataFrame:
    return _mean_rent(df.where(F.col("bedrooms") <= most), "bedrooms", "bedrooms").orderBy("bedrooms")


def mean_rent_by_type(df: DataFrame) -> DataFrame:
    return _mean_rent(df, "property_type", "type").orderBy(F.desc("avg_price"), "type")


def dashboard(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "price_distribution": price_bands(df).select("range", "count"),
        "avg_price_by_district": mean_rent_by_district(df),
        "avg_price_by_bedrooms": mean_rent_by_bedrooms(df),
        "avg_price_by_type": mean_rent_by_type(df),
    }
