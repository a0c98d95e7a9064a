"""Row numbers over a whole table without a window that gathers it in one task.

The rows are dealt by ranges of the order and sorted inside each range; a task numbers its own rows. The
rows of each range are counted, one row a range, and the sums before each range shift its numbers. Rows that
share a key are dealt by a digest of the whole row and their place in the input, so a hot key fills many
ranges and not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rentlens.session import stage

_IN_PART = 33  # bits of a monotonic id that count inside a partition


def ordinals(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """``df`` with the position of each row in the given order, from 0; a column of that name is replaced.

    Rows equal in the order follow a digest of all their columns, then their place in the input.
    """
    columns = [c for c in df.columns if c != name]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumns({"_digest": F.xxhash64(*[F.col(f"`{c}`") for c in columns]), "_read": F.monotonically_increasing_id()})
    sort = [*order, "_digest", "_read"]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", _IN_PART)
    placed = stage(placed.select(*[F.col(f"`{c}`") for c in columns], part.alias("_part"), (F.col("_place") - F.shiftleft(part, _IN_PART)).alias("_row")), "ordinals")
    # one row a range: as many as shuffle partitions
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(*[F.col(f"`{c}`") for c in columns], (F.col("_start") + F.col("_row")).alias(name))


def plot_positions(df: DataFrame, column: str, order: Sequence[str | Column], threshold: float = 3.0) -> DataFrame:
    """The order's columns, ``ordinal`` and ``outlier``: whether the value is over ``threshold`` deviations off the mean."""
    figures = df.agg(F.struct(F.avg(column).alias("mean"), F.stddev(column).alias("deviation")).alias("f")).scalar()
    outlier = F.abs(F.col(column) - figures["mean"]) / F.when(figures["deviation"] > 0, figures["deviation"]) > threshold
    return ordinals(df.select(*order, outlier.alias("outlier")), order)
