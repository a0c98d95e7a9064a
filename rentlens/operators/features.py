"""Training and serving feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.functions.features import room_features, type_flags
from rentlens.functions.numeric import clip, date_parts
from rentlens.operators import clean as C
from rentlens.operators.quantiles import one_row, quantile_table
from rentlens.operators.stats import frequency_encode
from rentlens.session import stage


def training_rows(df: DataFrame, rent_range=vocab.MODEL_RENT_RANGE, key: str = "listing_id") -> DataFrame:
    """Rows fit for training: target parsed and in range, gaps imputed by model type, numbers clipped,
    implausible layouts dropped. Missing flags are those of the input, or are taken before the cast."""
    df = C.drop_columns(C.require_columns(df, [vocab.TARGET]), vocab.LEAKAGE_COLUMNS)
    none = F.lit(None).cast("string")
    df = C.with_defaults(df, {c: F.lit(None).cast("double") for c in vocab.STRUCTURAL}
                         | {"property_type": F.lit(vocab.MODEL_TYPE_DEFAULT), "furnished": F.lit("unknown"),
                            "district": F.lit("unknown"), "posted_date": none})
    df = C.with_defaults(df, {f"{c}_was_missing": F.col(c).isNull().cast("double") for c in vocab.STRUCTURAL})
    df = C.numeric_columns(df, vocab.STRUCTURAL)
    rent = F.col(vocab.TARGET)
    text = dict(df.dtypes)[vocab.TARGET] == "string"
    df = C.evaluate_once(df, {vocab.TARGET: T.decimal_text(T.money_text(rent, "tokens")) if text else rent.cast("double")})
    df = C.filter_range(df, vocab.TARGET, *rent_range).withColumn("kind", T.model_type(F.col("property_type")))
    df = df.select(key, vocab.TARGET, *vocab.STRUCTURAL, *[f"{c}_was_missing" for c in vocab.STRUCTURAL],
                   "kind", "district", "furnished", "posted_date")
    df = C.impute_median(df, vocab.STRUCTURAL, by="kind", closed=True)
    df = df.withColumns({c: clip(F.col(c), *vocab.BOUNDS[c]) for c in vocab.STRUCTURAL})
    return C.plausible_layout(df)


def target_mask(df: DataFrame) -> Column:
    """Rows inside the log-rent IQR fences and inside the 1-99 % band of rent per square metre.

    Both bands are measured on the same rows of ``df``, in one pass.
    """
    log_rent = F.log1p(vocab.TARGET)
    pps = F.col(vocab.TARGET) / clip(F.col("size_sqm"), lo=1.0)
    cut = one_row(quantile_table(df.select(log_rent.alias("log_rent"), pps.alias("pps")), [], {
        "q1": ("log_rent", 0.25), "q3": ("log_rent", 0.75), "low": ("pps", 0.01), "high": ("pps", 0.99),
    }))
    reach = (cut["q3"] - cut["q1"]) * 1.5
    return log_rent.between(cut["q1"] - reach, cut["q3"] + reach) & pps.between(cut["low"], cut["high"])


def target_filters(df: DataFrame) -> DataFrame:
    return df.where(target_mask(df))


def with_features(df: DataFrame) -> DataFrame:
    """Row-local features of training rows that carry ``kind`` and ``district_freq``."""
    dates = {n: F.coalesce(c, F.lit(0.0)) for n, c in date_parts(F.col("posted_date")).items()}
    return df.withColumns(
        {
            **room_features(F.col("size_sqm"), F.col("bedrooms"), F.col("bathrooms")),
            **type_flags(F.col("kind")),
            **dates,
            "furnished_score": T.furnished_flag(F.col("furnished")),
            **{f"{c}_was_missing": F.col(f"{c}_was_missing").cast("double") for c in vocab.STRUCTURAL},
        }
    )


def feature_columns(df: DataFrame, key: str = "listing_id", outlier_filter: bool = True) -> DataFrame:
    """Feature table: key, target and the model features in fixed order.

    The narrow training rows are stored once; district shares and outlier bands are read from them.
    """
    rows = stage(training_rows(df, key=key), "training")
    keep = target_filters(rows) if outlier_filter else rows
    district = F.lower(T.strip(F.coalesce(F.col("district"), F.lit("unknown"))))
    keep = frequency_encode(keep, district, "district_freq", of=rows)
    return select_features(with_features(keep), key)


def select_features(df: DataFrame, key: str, names: Sequence[str] = tuple(vocab.MODEL_FEATURES)) -> DataFrame:
    """Fixed feature order; an absent feature is 0."""
    df = C.with_defaults(df, {n: F.lit(0.0) for n in names})
    carried = [c for c in (key, vocab.TARGET) if c in df.columns]
    return df.select(*carried, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])


def assemble(df: DataFrame, names: Sequence[str] = tuple(vocab.MODEL_FEATURES), output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=output).transform(df)
