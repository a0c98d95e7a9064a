"""Blocked Bloom filters as small tables, built and asked with column functions only.

A key's 64-bit digest chooses one block of 64 bits and four bits in it. Blocks are kept in pages of 1,024,
one row each. The number of pages follows the number of keys up to a fixed limit, so the table that is
broadcast has a proven bound: ``2 ** MAX_PAGE_BITS`` pages of 8 KB. Beyond about 16 keys a block more
foreign keys pass; the exact step behind the filter removes them, so results do not depend on the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1024
MAX_PAGE_BITS = 12
KEYS_PER_BLOCK = 4


def page_bits(keys: int) -> int:
    """Power of two of pages for so many keys, two at least."""
    return min(MAX_PAGE_BITS, max(1, (max(keys, 1) // (KEYS_PER_BLOCK * PAGE)).bit_length()))


def page(digest: Column, bits: int) -> Column:
    return F.shiftrightunsigned(digest, 64 - bits).cast("int")


def block(digest: Column) -> Column:
    """Place of the key's block in its page."""
    return (F.shiftrightunsigned(digest, 24) % PAGE).cast("int")


def pattern(digest: Column) -> Column:
    """The key's bits in its block."""
    out = None
    for at in (0, 6, 12, 18):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(digest, at).bitwiseAND(F.lit(63))).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def build(keys: DataFrame, digest: str, bits: int) -> DataFrame:
    """The filter of a column of digests: ``page``, ``blocks``. Equal blocks meet before the shuffle."""
    d = F.col(digest)
    blocks = keys.where(d.isNotNull()).groupBy(page(d, bits).alias("page"), block(d).alias("block")).agg(F.bit_or(pattern(d)).alias("bits"))
    filled = blocks.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("filled"))
    every = F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda i: F.coalesce(F.try_element_at("filled", i), F.lit(0).cast("long")))
    return filled.select("page", every.alias("blocks"))


def ask(rows: DataFrame, digest: str, pages: DataFrame, bits: int, flag: str) -> DataFrame:
    """Rows with ``flag``: false if the key is not in the filter, true if it may be. Null keys are not."""
    d = F.col(digest)
    held = F.broadcast(pages.select(F.col("page").alias("_page"), F.col("blocks").alias("_blocks")))
    joined = rows.withColumn("_at", page(d, bits)).join(held, F.col("_at") == F.col("_page"), "left")
    own = pattern(d)
    hit = F.get("_blocks", block(d)).bitwiseAND(own) == own
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_at", "_page", "_blocks")
