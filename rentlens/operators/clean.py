"""Cleaning operators: filters, flags, defaults, imputation, deduplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.functions.numeric import finite
from rentlens.operators.lookup import lookup_join
from rentlens.operators.quantiles import one_row, quantile_table, quantiles_long, scoped_measures
from rentlens.session import stage


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def column_presence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``present`` and the table's ``rows`` (null where the column is absent) of each required column."""
    said = [F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present")) for c in columns]
    rows = df.agg(F.count("*").alias("n")).select("n", F.inline(F.array(*said)))
    return rows.select("column", "present", F.when(F.col("present"), F.col("n")).alias("rows"))


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are absent."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def evaluate_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns, each computed once per row.

    A filter or a second use of an ordinary computed column makes the optimizer repeat its expression,
    which is dear for text patterns. Columns that come out of a generator are not repeated.
    """
    kept = [c for c in df.columns if c not in columns]
    order = [*df.columns, *[c for c in columns if c not in df.columns]]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row))).select(*order)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lenient cast to double; a column that is numeric already only loses NaN and infinities."""
    texts = {c: T.decimal_text(F.col(c)) for c in columns if dict(df.dtypes)[c] == "string"}
    df = evaluate_once(df, texts) if texts else df
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})


def filter_range(df: DataFrame, column: str, lo: float, hi: float, keep_null: bool = False) -> DataFrame:
    inside = F.col(column).between(lo, hi)
    return df.where(inside | F.col(column).isNull()) if keep_null else df.where(inside)


def drop_missing(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(columns))


def missing_flags(df: DataFrame, columns: Sequence[str], dtype: str = "int") -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast(dtype) for c in columns})


def dedup(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Drop repeated rows, or keep one row per key: the smallest by all other columns.

    Both forms combine copies before the shuffle, so a large group of copies costs one row per task.
    """
    if keys is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).dropDuplicates()
    kept = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("kept"))
    return kept.select(*keys, "kept.*").select(*df.columns)


def medians_by(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    return quantile_table(df, [by], {f"{c}_median": (c, 0.5) for c in columns})


def impute_median(df: DataFrame, columns: Sequence[str], by: str | None, closed: bool = False) -> DataFrame:
    """Fill nulls by the median of the group, then by the median of all rows.

    Group and overall medians come from one pass, as two scopes of the same values, and are stored:
    one small row per group. ``closed`` says that ``by`` holds a fixed vocabulary.
    """
    if by is None:
        overall = one_row(quantile_table(df, [], {c: (c, 0.5) for c in columns}))
        return df.withColumns({c: F.coalesce(F.col(c), overall[c]) for c in columns})
    parts = [("all", F.lit(None), c, F.col(c)) for c in columns] + [("group", F.col(by), c, F.col(c)) for c in columns]
    long = stage(quantiles_long(scoped_measures(df, parts), ["scope", "key", "measure"], [0.5]), "medians")
    pick = lambda c: F.max(F.when(F.col("measure") == c, F.col("quantile")))
    overall = one_row(long.where(F.col("scope") == "all").agg(*[pick(c).alias(c) for c in columns]))
    groups = long.where(F.col("scope") == "group").groupBy(F.col("key").alias(by)).agg(
        *[pick(c).alias(f"{c}_median") for c in columns]
    )
    out = lookup_join(df, groups, [by], small=True if closed else None)
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"{c}_median"), overall[c]) for c in columns}
    ).drop(*[f"{c}_median" for c in columns])


def plausible_layout(df: DataFrame, min_sqm: float = vocab.MIN_SQM_PER_ROOM) -> DataFrame:
    rooms = F.greatest(F.col("bedrooms") + F.col("bathrooms"), F.lit(1.0))
    return df.where(F.col("size_sqm") / rooms >= min_sqm)


def scope_filter(df: DataFrame, column: str, token_groups=None) -> DataFrame:
    """Keep the rows whose place is in scope; if none is, keep all."""
    hit = F.coalesce(T.in_scope(F.col(column), token_groups or vocab.SCOPE_TOKEN_GROUPS), F.lit(False))
    any_hit = df.agg(F.coalesce(F.bool_or(hit), F.lit(False))).scalar()
    return df.where(hit | ~any_hit)


def sale_like(title: Column, pattern: str = vocab.SALE_PATTERN) -> Column:
    return F.coalesce(F.lower(title).rlike(pattern), F.lit(False))


def drop_sale_like(df: DataFrame, column: str = "title") -> DataFrame:
    """Drop listings whose title speaks of a sale; a null title stays."""
    return df.where(~sale_like(F.col(column)))


def attributes_from_text(df: DataFrame, column: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``<name>_text`` per attribute: group 1 of the first matching pattern."""
    return df.withColumns({f"{name}_text": T.first_match(F.col(column), p) for name, p in patterns.items()})


def fill_attributes(df: DataFrame, defaults=None, other=vocab.OTHER_TYPE_DEFAULTS) -> DataFrame:
    """Column, then title text, then (for size) a dimension product, then a default by type."""
    defaults = defaults or vocab.TYPE_DEFAULTS
    title = F.coalesce(F.col("title"), F.lit(""))
    kind = F.coalesce(T.strip(F.col("property_type")), F.lit("Other"))
    by_type = {
        name: F.coalesce(T.lookup(kind, {t: float(v[i]) for t, v in defaults.items()}), F.lit(float(other[i])))
        for name, i in (("bedrooms", 0), ("bathrooms", 1), ("size_sqm", 2))
    }
    found = {f"{n}_title": T.decimal_text(T.first_match(title, p)) for n, p in vocab.TITLE_PATTERNS.items()}
    found["dimensions"] = T.dimension_product(title)
    df = evaluate_once(numeric_columns(df, vocab.STRUCTURAL), found)
    parts = {n: [F.col(n), finite(F.col(f"{n}_title"))] for n in by_type}
    parts["size_sqm"].append(finite(F.col("dimensions")))
    return df.withColumns({n: F.coalesce(*parts[n], by_type[n]) for n in by_type}).drop(*found)


def _invalid(form_min_size: float | None) -> Column:
    checks = [
        (F.col("size_sqm").isNull() | F.col("bedrooms").isNull() | F.col("bathrooms").isNull(), "missing number"),
        (F.col("property_type").isNull(), "missing property type"),
        (finite(F.col("size_sqm")).isNull(), "size is not finite"),
        ((F.col("bedrooms") > vocab.MAX_ROOMS) | (F.col("bathrooms") > vocab.MAX_ROOMS), "too many rooms"),
        (F.col("size_sqm") <= 0, "size must be above 0"),
    ]
    if form_min_size is not None:
        checks.append((F.col("size_sqm") < form_min_size, f"size must be at least {form_min_size:g}"))
    checks += [
        (F.col("bedrooms") < 0, "bedrooms must not be below 0"),
        (F.col("bathrooms") < 1, "bathrooms must be at least 1"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(reason)) for bad, reason in checks])


def checked_requests(df: DataFrame, form_min_size: float | None = None) -> DataFrame:
    """Add ``reason``, null for a valid request, and truncate room counts to whole numbers."""
    return df.withColumn("reason", _invalid(form_min_size)).withColumns(
        {c: F.col(c).try_cast("int") for c in ("bedrooms", "bathrooms")}
    )


def validate_requests(df: DataFrame, form_min_size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and rejected ones with a reason."""
    checked = checked_requests(df, form_min_size)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())
