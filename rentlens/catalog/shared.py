"""Tables that several queries start from, built once per session and data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.operators import clean as C
from rentlens.operators.context import MarketContext, build_context, load_context, save_context
from rentlens.operators.features import feature_columns, training_rows
from rentlens.operators.scoring import attach_market
from rentlens.plans.cleaning import clean_listings
from rentlens.plans.eda import prepare_eda
from rentlens.session import new_folder
from rentlens.sources.csv_files import path_exists
from rentlens.sources.shared_tables import listings_raw

_PATHS: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The named table of this session and folder; built and written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS or not path_exists(spark, f"{_PATHS[key]}/_SUCCESS"):
        path = new_folder(spark, name)
        build().write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "clean", lambda: clean_listings(listings_raw(spark, sf_dir)))


def eda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_eda(clean(spark, sf_dir))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "training", lambda: training_rows(clean(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "features", lambda: feature_columns(clean(spark, sf_dir)))


def context(spark: SparkSession, sf_dir: str) -> MarketContext:
    key = (spark.sparkContext.applicationId, sf_dir, "context")
    if key not in _PATHS or not path_exists(spark, f"{_PATHS[key]}/regions/_SUCCESS"):
        path = new_folder(spark, "context")
        save_context(build_context(clean(spark, sf_dir)), path)
        _PATHS[key] = path
    return load_context(spark, _PATHS[key])


def all_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw listing as a score request; some lack a number or a type."""
    asked = listings_raw(spark, sf_dir).select(
        F.col("listing_id").alias("request_id"), "size_sqm", "bedrooms", "bathrooms", "property_type",
        F.col("furnished").alias("furnishing"), "district", "location", "city",
    )
    return parsed_requests(asked)


def parsed_requests(asked: DataFrame) -> DataFrame:
    return C.evaluate_once(asked, {c: T.number_in(F.col(c)) for c in vocab.STRUCTURAL})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate_requests(all_requests(spark, sf_dir))[0]


def market_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid requests with type and district resolved."""
    return stored(
        spark, sf_dir, "market_requests",
        lambda: attach_market(requests(spark, sf_dir), context(spark, sf_dir), cutoff=None),
    )


def stand_in(df: DataFrame) -> DataFrame:
    """Fixed formula in place of a model, so that scores can be checked in SQL."""
    return df.withColumn("raw_price", F.col("size_sqm") * 8 + F.col("bedrooms") * 150 + F.col("bathrooms") * 120)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that sums in another order compare equal."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t == "double"})
