"""Joins of a large table with a lookup table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.session import stage

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(
    table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure a stored lookup table: rows, and bytes of all its columns written out."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def lookup_join(facts: DataFrame, table: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """Left join; null keys match null keys.

    ``small`` says that the lookup table is bounded by a fixed vocabulary or was measured. If it is not
    given, the table is stored and measured. A table that does not fit is joined by shuffle; partitions of
    hot keys are split by their measured size at run time (``spark.sql.adaptive.skewJoin``), so only hot keys
    are copied.
    """
    if small is None:
        table = stage(table, "lookup")
        small = fits_broadcast(table)
    right = table.withColumnsRenamed({k: f"lookup_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"lookup_{k}"))
    return facts.join(F.broadcast(right) if small else right, same, "left").drop(*[f"lookup_{k}" for k in keys])
