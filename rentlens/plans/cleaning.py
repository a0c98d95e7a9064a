"""Raw listings to clean listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.functions.numeric import clip, finite, null_outside
from rentlens.operators import clean as C
from rentlens.session import stage


def parse_listings(df: DataFrame, money: str = "class") -> DataFrame:
    """Row-local part of cleaning: numbers, impossible values, vocabularies."""
    parsed = {c: T.number_in(F.col(c)) for c in vocab.STRUCTURAL}
    parsed[vocab.TARGET] = T.decimal_text(T.money_text(F.col(vocab.TARGET), money))
    parsed["property_type"] = T.clean_type(F.col("property_type"))
    if "furnished" in df.columns:
        parsed["furnished"] = T.normalize_furnished(F.col("furnished"))
    df = C.evaluate_once(df, parsed)
    return df.withColumns(
        {
            vocab.TARGET: finite(F.col(vocab.TARGET)),
            **{c: null_outside(finite(F.col(c)), *vocab.POSSIBLE[c]) for c in vocab.STRUCTURAL},
        }
    )


def usable_listings(df: DataFrame, rent_range=vocab.CLEAN_RENT_RANGE) -> DataFrame:
    """Parsed rows with a possible or missing rent and at least one structural number."""
    df = C.filter_range(parse_listings(df), vocab.TARGET, *rent_range, keep_null=True)
    df = C.drop_missing(df, vocab.STRUCTURAL, how="all")
    return C.missing_flags(df, vocab.STRUCTURAL)


def clean_listings(
    df: DataFrame,
    rent_range=vocab.CLEAN_RENT_RANGE,
    deduplicate: bool = True,
    parity: bool = False,
) -> DataFrame:
    """Deduplicate, parse, filter, flag and impute.

    The deduplicated, parsed rows are stored before imputation: medians then read three columns of
    that table and the result reads it once, instead of repeating the deduplication shuffle.
    ``parity`` drops the administrative columns and the flags, as the published table does.
    """
    if deduplicate:
        df = C.dedup(df)
    df = stage(usable_listings(df, rent_range), "usable")
    df = C.impute_median(df, vocab.STRUCTURAL, by="property_type", closed=True)
    if parity:
        df = C.drop_columns(df, [*vocab.ADMIN_COLUMNS, *[f"{c}_was_missing" for c in vocab.STRUCTURAL]])
    return df


def auto_clean(df: DataFrame) -> DataFrame:
    """Fallback cleaning of raw listings that lack structural columns: text, then type defaults."""
    C.require_columns(df, ["listing_id", "city", "district", "location", "property_type", vocab.TARGET])
    df = C.with_defaults(df, {c: F.lit(None).cast("string") for c in [*vocab.STRUCTURAL, "title"]})
    df = C.evaluate_once(df, {vocab.TARGET: T.decimal_text(T.money_text(F.col(vocab.TARGET), "tokens"))})
    df = C.fill_attributes(df).withColumn(vocab.TARGET, finite(F.col(vocab.TARGET)))
    df = C.drop_missing(df, [vocab.TARGET])
    df = df.withColumns({c: clip(F.col(c), *vocab.BOUNDS[c]) for c in vocab.STRUCTURAL})
    kind = F.coalesce(T.strip(F.col("property_type")), F.lit("Other"))
    return df.withColumn("property_type", kind).select(*vocab.EDA_REQUIRED)
