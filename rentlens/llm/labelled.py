"""Held-out folds and bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 5, is 0. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled_ids(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows outside the held-out fold, in the order of a digest of their id."""
    known = rows.where(F.col("doc_id").isNotNull() & ~held_out())
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def labelled_texts(documents: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """``text`` and ``label`` of at most ``limit`` label rows. The sample is broadcast: its size is the bound."""
    wanted = labels.where(F.col(target).isNotNull()).select("doc_id", F.col(target).cast("int").alias("label"))
    sample = F.broadcast(sampled_ids(wanted, limit))
    return documents.select("doc_id", "text").join(sample, "doc_id").select("text", "label")
