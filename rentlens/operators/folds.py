"""Train/test splits and folds without a global sort.

Rows are ordered by id, or by a digest of id and seed. Only the few order statistics where the next
part begins are looked up; every row is then assigned by comparing its own order value with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.operators.quantiles import measures, one_row, order_statistics, quantiles_long


def row_digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def _first_of_each_fold(k: int) -> Column:
    """Ranks at which folds 1 .. k-1 begin; the first ``n % k`` folds have one row more."""
    n = F.col("group_n")
    starts = [
        F.struct(F.lit(j).alias("label"), (F.floor(n / k) * j + F.least(F.pmod(n, F.lit(k)), F.lit(j))).alias("rank"))
        for j in range(1, k)
    ]
    return F.array(*starts)


def fold_column(
    df: DataFrame, k: int, key: str = "listing_id", shuffle: bool = False, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold number 0 .. k-1 of each row: contiguous in id order, or in digest order if shuffled.

    Ids may be whole numbers or texts; rows without an id are in fold 0, repeated ids in one fold.
    """
    ordered = df.withColumn("order_value", row_digest(key, seed) if shuffle else F.col(key))
    found = order_statistics(ordered, [], _first_of_each_fold(k), "order_value")
    starts = one_row(found.agg(*[F.max(F.when(F.col("label") == j, F.col("v"))).alias(f"s{j}") for j in range(1, k)]))
    passed = sum((_as_int(starts[f"s{j}"] <= F.col("order_value")) for j in range(1, k)), F.lit(0))
    return ordered.withColumn(name, passed).drop("order_value")


def _as_int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def strata_edges(df: DataFrame, label: str = vocab.TARGET, bins: int = 10) -> DataFrame:
    """Distinct quantile edges of the label, in order, as one array of at most ``bins + 1`` values."""
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles_long(measures(df, [], {label: label}), [], probs)
    return edges.agg(F.array_sort(F.collect_set("quantile")).alias("edges"))


def stratum(c: Column, edges: Column, bins: int = 10) -> Column:
    """Right-closed stratum of a value, the lowest edge included."""
    below = sum((_as_int(F.get(edges, F.lit(i)) < c) for i in range(bins + 1)), F.lit(0))
    return F.greatest(below - 1, F.lit(0))


def stratified_split(
    df: DataFrame, label: str = vocab.TARGET, test_share: float = 0.2, seed: int = 42, key: str = "listing_id",
    bins: int = 10,
) -> DataFrame:
    """Add ``stratum`` and ``is_test``: in each label stratum the share of rows first in digest order."""
    marked = df.withColumn("stratum", stratum(F.col(label), strata_edges(df, label, bins).scalar(), bins))
    marked = marked.withColumn("order_value", row_digest(key, seed))
    size = F.round(F.col("group_n") * test_share).cast("long")
    last = F.filter(F.array(F.struct(F.lit(0).alias("label"), (size - 1).alias("rank"))), lambda w: w["rank"] >= 0)
    found = order_statistics(marked, ["stratum"], last, "order_value")
    cuts = found.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "v"))).alias("cuts")).scalar()
    is_test = F.col("order_value") <= F.element_at(cuts, F.col("stratum"))
    return marked.withColumn("is_test", F.coalesce(is_test, F.lit(False))).drop("order_value")
