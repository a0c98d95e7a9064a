"""Exact order statistics and quantiles of large, skewed groups.

The built-in ``percentile`` holds all distinct values of a group in one task. Here a histogram of narrow
buckets that keep the order of the values comes first: counts and bounds only, added up before the shuffle.
The counts locate the few buckets that hold the wanted ranks. A located bucket with more rows than a limit
gets a histogram of its own between its bounds, until it is small or all its values are equal. Only then
are the values of the located buckets fetched, counted where equal, and sorted, each bucket on its own. No
task sees a whole group, and values elsewhere never move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.session import stage

BUCKET_ROWS = 100_000
RANGES_BROADCAST = 100_000
_PARTS = 4096
# Buckets per doubling of a value; the offset keeps bucket numbers of all doubles positive.
_PER_OCTAVE = 1024
_OFFSET = 1075 * _PER_OCTAVE + 1
_WIDE = "decimal(38,0)"


def _double_bucket(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * _PER_OCTAVE) + F.lit(_OFFSET)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size).cast("long")


def _common_prefix(a: Column, b: Column) -> Column:
    return F.length(F.regexp_extract(F.concat(a, F.lit("\x00"), b), r"(?s)^(.*).*\x00\1", 1))


def _first_bucket(kind: T.DataType, v: Column) -> Column:
    """Bucket that never decreases as ``v`` grows, without knowledge of the data."""
    if isinstance(kind, T.StringType):
        return F.substring(v, 1, 2)
    if isinstance(kind, T.IntegralType):
        return F.shiftright(v.cast("long"), 40)
    return _double_bucket(v)


def _inner_bucket(kind: T.DataType, v: Column, low: Column, high: Column) -> Column:
    """Bucket of ``v`` between two bounds: equal widths, or the next characters after the common beginning."""
    if isinstance(kind, T.StringType):
        return F.substring(v, _common_prefix(low, high) + 1, F.lit(2))
    if isinstance(kind, T.IntegralType):
        width = F.floor((high.cast(_WIDE) - low.cast(_WIDE)) / _PARTS) + 1
        return F.floor((v.cast(_WIDE) - low.cast(_WIDE)) / width).cast("long")
    return F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * _PARTS).cast("long")


def _same(names: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return same


def _in_ranges(values: DataFrame, located: DataFrame, keys: list[str]) -> DataFrame:
    """Values inside located ranges, with the range's bounds ``low`` and ``high``."""
    ranges = located.select(*[F.col(k).alias(f"at_{k}") for k in [*keys, "bucket"]], "low", "high").distinct()
    small = located.count() <= RANGES_BROADCAST
    inside = _same([*keys, "bucket"], "at_") & F.col("v").between(F.col("low"), F.col("high"))
    joined = values.join(F.broadcast(ranges) if small else ranges, inside)
    return joined.drop(*[f"at_{k}" for k in [*keys, "bucket"]])


def _upto(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows with ``upto``, the running sum of ``n`` in the group."""
    window = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    return rows.withColumn("upto", F.sum("n").over(window.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def _located(values: DataFrame, keys: list[str], wanted: Column, kind: T.DataType) -> DataFrame:
    """``keys, bucket, low, high, n, group_n, label, rank, before``: the range that holds each wanted rank."""
    found = values.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    group = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = _upto(found.withColumn("group_n", F.sum("n").over(group)), keys, "bucket")
    names = [*keys, "bucket", "low", "high", "n", "group_n"]
    found = found.withColumn("want", F.explode(wanted)).select(
        *names, "want.label", F.col("want.rank").cast("long").alias("rank"), (F.col("upto") - F.col("n")).alias("before"), "upto")
    return found.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto"))).drop("upto")


def _refined(values: DataFrame, located: DataFrame, keys: list[str], kind: T.DataType, limit: int) -> DataFrame:
    """Ranges with more than ``limit`` rows replaced by the narrower ones that hold the ranks."""
    is_large = (F.col("n") > limit) & (F.col("low") < F.col("high"))
    large, rest = located.where(is_large), located.where(~is_large)
    inside = _in_ranges(values, large, keys).withColumn("part", _inner_bucket(kind, F.col("v"), F.col("low"), F.col("high")))
    group = [*keys, "bucket", "low", "high"]
    parts = inside.groupBy(*group, "part").agg(F.count("*").alias("n"), F.min("v").alias("new_low"), F.max("v").alias("new_high"))
    parts = _upto(parts, group, "part").drop("part").withColumnsRenamed({k: f"in_{k}" for k in group} | {"n": "new_n"})
    asked = large.drop("n").join(parts, _same(group, "in_"))
    start = F.col("before") + F.col("upto") - F.col("new_n")
    hit = (start <= F.col("rank")) & (F.col("rank") < start + F.col("new_n"))
    narrow = asked.where(hit).select(
        *keys, "bucket", F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("new_n").alias("n"), "group_n", "label", "rank", start.alias("before"))
    return rest.unionByName(narrow)


def order_statistics(df: DataFrame, keys: Sequence[str], wanted: Column, value: str = "v", limit: int = BUCKET_ROWS) -> DataFrame:
    """Values at the wanted ranks of each group of ``keys``; null values are left out.

    ``wanted`` is an array of ``struct(label, rank)`` over the keys and ``group_n``, the number of values in
    the group; ranks start at 0. The values may be numbers or texts. The histograms are computed when this
    is called, so ``df`` is read once for them and once for the values.

    Gives ``keys, label, rank, group_n, v``.
    """
    keys = list(keys)
    kind = df.select(value).schema[0].dataType
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v")).withColumn("bucket", _first_bucket(kind, F.col("v")))
    located = stage(_located(values, keys, wanted, kind), "ranks")
    while not located.where((F.col("n") > limit) & (F.col("low") < F.col("high"))).isEmpty():
        located = stage(_refined(values, located, keys, kind, limit), "ranks")
    group = [*keys, "bucket", "low", "high"]
    counted = _in_ranges(values, located, keys).groupBy(*group, "v").agg(F.count("*").alias("n"))
    counted = _upto(counted, group, "v").withColumnsRenamed({k: f"in_{k}" for k in group} | {"n": "equal"})
    hit = F.col("rank") - F.col("before")
    return (
        located.join(counted, _same(group, "in_"))
        .where((hit >= F.col("upto") - F.col("equal")) & (hit < F.col("upto")))
        .select(*keys, "label", "rank", "group_n", "v")
    )


def _ranks(probs: Column) -> Column:
    """Lower and upper neighbours of each probability's position in a group of ``group_n``."""
    position = lambda p: p * (F.col("group_n") - 1)
    low = F.transform(probs, lambda p: F.struct(p.alias("label"), F.floor(position(p)).alias("rank")))
    high = F.transform(probs, lambda p: F.struct(p.alias("label"), F.ceil(position(p)).alias("rank")))
    return F.array_distinct(F.concat(low, high))


def quantiles_long(
    df: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float] | Column,
    value: str = "v",
) -> DataFrame:
    """Linearly interpolated quantiles: ``keys, prob, quantile, group_n``."""
    if not isinstance(probs, Column):
        probs = F.array(*[F.lit(float(p)) for p in probs])
    found = order_statistics(df, keys, _ranks(probs), value=value)
    position = F.col("prob") * (F.col("group_n") - 1)
    part = position - F.floor(position)
    return (
        found.groupBy(*keys, F.col("label").alias("prob"), "group_n")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"))
        .select(*keys, "prob", (F.col("low") + (F.col("high") - F.col("low")) * part).alias("quantile"), "group_n")
    )


def measures(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column | str]) -> DataFrame:
    """Long form ``keys, measure, v`` of several numeric columns, without nulls."""
    parts = [
        F.struct(F.lit(name).alias("measure"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v"))
        for name, c in columns.items()
    ]
    return (
        df.select(*keys, F.explode(F.array(*parts)).alias("m"))
        .select(*keys, "m.measure", "m.v")
        .where(F.col("v").isNotNull())
    )


def scoped_measures(df: DataFrame, parts: Sequence[tuple[str, Column, str, Column]]) -> DataFrame:
    """Long form ``scope, key, measure, v`` of ``(scope, key, measure, value)`` parts, without nulls.

    Several groupings of the same rows become one table, so that one pass serves all of them.
    """
    cells = [
        F.struct(F.lit(scope).alias("scope"), key.cast("string").alias("key"), F.lit(measure).alias("measure"),
                 v.cast("double").alias("v"))
        for scope, key, measure, v in parts
    ]
    return df.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where(F.col("v").isNotNull())


def column_quantiles(df: DataFrame, columns: Sequence[str], spec: Mapping[str, float]) -> DataFrame:
    """One row per column of ``df``, with a quantile per entry of ``spec``: name -> probability."""
    long = quantiles_long(measures(df, [], {c: c for c in columns}), ["measure"], sorted(set(spec.values())))
    return long.groupBy("measure").agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name) for name, p in spec.items()]
    )


def quantile_table(
    df: DataFrame,
    keys: Sequence[str],
    spec: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """One row per group with a column per entry of ``spec``: name -> (column, probability)."""
    columns = {c: c for c, _ in spec.values()}
    probs = {c: sorted({p for col, p in spec.values() if col == c}) for c in columns}
    wanted = F.lit(None)
    for c, ps in probs.items():
        wanted = F.when(F.col("measure") == c, F.array(*[F.lit(float(p)) for p in ps])).otherwise(wanted)
    long = quantiles_long(measures(df, keys, columns), [*keys, "measure"], wanted)
    return long.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("measure") == c) & (F.col("prob") == float(p)), F.col("quantile"))).alias(name)
            for name, (c, p) in spec.items()
        ]
    )


def one_row(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct usable in another DataFrame's expressions."""
    return df.select(F.struct(*df.columns)).scalar()
