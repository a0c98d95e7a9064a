"""Quantiles with a stated rank error from mergeable sketches.

A KLL sketch holds a bounded sample of weighted values whose size depends on the asked accuracy only, not on
the rows. Sketches of parts of a table merge into a sketch of the whole, so stored ones stand in for history
that need not be read again. Both aggregates combine before the shuffle; a hot group sends one sketch a task.

Groups of up to ``sketch_size(accuracy)`` values are held whole, and their quantiles are exact order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.operators.lookup import lookup_join
from rentlens.session import stage

# --- fixed values: least and largest sketch parameter, and its published error law ---
LEAST_K, LARGEST_K = 8, 65535
ERROR_SCALE, ERROR_POWER = 2.446, 0.9433


def rank_error(k: int) -> float:
    """Largest distance of a quantile's true rank from the asked one, as a share of the rows, with 99 % confidence."""
    return ERROR_SCALE / k**ERROR_POWER


def sketch_size(accuracy: float) -> int:
    """Smallest sketch parameter whose rank error is at most ``accuracy``."""
    if not rank_error(LARGEST_K) <= accuracy < 1:
        raise ValueError(f"accuracy lies between {rank_error(LARGEST_K):.1e} and 1")
    k = max(LEAST_K, int((ERROR_SCALE / accuracy) ** (1 / ERROR_POWER)))
    while rank_error(k) > accuracy:
        k += 1
    return k


def sketched(df: DataFrame, keys: Sequence[str], value: str, accuracy: float) -> DataFrame:
    """``keys, sketch, n`` of the values that are not null; groups without any are left out."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull())
    cells = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("v", F.lit(sketch_size(accuracy))).alias("sketch"), F.count("*").alias("n"))
    return cells.where("n > 0")


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, sketch, n`` of wider groups, from sketches of equal accuracy."""
    cells = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return cells.where("n > 0")


def read_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The other columns of the sketches, ``prob`` and ``quantile``, one row for each probability."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    others = [c for c in sketches.columns if c != "sketch"]
    found = sketches.select(*others, F.kll_sketch_get_quantile_double("sketch", asked).alias("found"))
    pairs = F.zip_with(asked, F.col("found"), lambda p, q: F.struct(p.alias("prob"), q.alias("quantile")))
    return found.select(*others, F.inline(pairs))


def quantiles_by_sketch(df: DataFrame, keys: Sequence[str], probs: Sequence[float], value: str, accuracy: float = 0.01) -> DataFrame:
    """``keys, n, prob, quantile`` by group; the true rank of each quantile is at most ``accuracy`` off."""
    return read_quantiles(sketched(df, keys, value, accuracy), probs)


def rank_gaps(df: DataFrame, quantiles: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``quantiles`` with ``gap``, the distance of ``prob`` from the ranks that ``quantile`` truly has in the data.

    One more pass over the data, to judge a sketch. A value that many rows share has a range of ranks; a
    probability in it has no gap.
    """
    keys = list(keys)
    quantiles = stage(quantiles, "judged")  # sketches draw at random, a second reading would differ
    asked = quantiles.groupBy(*keys).agg(F.collect_set(F.struct("prob", "quantile")).alias("asked"))
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    counted = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    pairs = lookup_join(counted, asked, keys).select(*keys, "v", "n", F.inline("asked"))
    shares = pairs.groupBy(*keys, "prob", "quantile").agg(
        (F.sum(F.when(F.col("v") < F.col("quantile"), F.col("n")).otherwise(0)) / F.sum("n")).alias("below"),
        (F.sum(F.when(F.col("v") <= F.col("quantile"), F.col("n")).otherwise(0)) / F.sum("n")).alias("upto"),
    )
    gap = F.greatest(F.col("below") - F.col("prob"), F.col("prob") - F.col("upto"), F.lit(0.0))
    return lookup_join(quantiles, shares.select(*keys, "prob", "quantile", gap.alias("gap")), [*keys, "prob", "quantile"])
