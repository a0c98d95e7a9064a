"""Exact deduplication with two Bloom passes.

Pass one: each task sets the bits of its texts' digests in a filter of digests seen and, where a digest's bits
were there before, in a filter of digests seen twice. Only the pages of these filters shuffle; merged, the
second one holds every digest that occurs more than once, in one task or in several. Pass two asks it: rows
it rejects are unique for certain and pass straight through, only the others shuffle, grouped by the SHA-256
of the normalised text.

Null counts as empty text; all empty and blank texts are equal. The row with the most code points in the
original text stays, then the smallest ``doc_id`` (null last), then the first read. Repeated rows with one
id are separate rows of the group. Filters have the bounded size of :mod:`rentlens.llm.bloom`; with more keys
than that more unique rows take the exact step, and results stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm import bloom
from rentlens.session import stage

KEYS_A_TASK = 1 << 22  # two filters of 32 MB are then less than the digests and their cells
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """Text without blanks and line breaks of ASCII."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _places(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and pattern of each digest, as :func:`bloom.block` and :func:`bloom.pattern` have them."""
    at = (digests >> np.uint64(64 - bits)) * np.uint64(bloom.PAGE) + (digests >> np.uint64(24)) % np.uint64(bloom.PAGE)
    own = np.zeros(len(digests), np.uint64)
    for shift in (0, 6, 12, 18):
        own |= np.uint64(1) << ((digests >> np.uint64(shift)) & np.uint64(63))
    return at.astype(np.int64), own


def _two_filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Pages of one task's filters: bits of digests seen, and of those that may have been seen before."""
    seen, twice = np.zeros((2, bloom.PAGE << bits), np.uint64)
    for batch in batches:
        digests, times = np.unique(batch.column(0).to_numpy().view(np.uint64), return_counts=True)
        at, own = _places(digests, bits)
        again = (times > 1) | (seen[at] & own == own)
        np.bitwise_or.at(twice, at[again], own[again])
        np.bitwise_or.at(seen, at, own)
    seen, twice = seen.reshape(-1, bloom.PAGE), twice.reshape(-1, bloom.PAGE)
    for page in np.flatnonzero(seen.any(axis=1)).tolist():
        yield pa.RecordBatch.from_pydict({"page": pa.array([page], pa.int32()), "seen": [seen[page].tobytes()], "twice": [twice[page].tobytes()]})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page: bits that some task has seen twice or several tasks have seen."""
    pages: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for page, *both in zip(*(column.to_pylist() for column in batch.columns)):
            seen, twice = (np.frombuffer(b, np.uint64) for b in both)
            if page in pages:
                before, again = pages[page]
                seen, twice = before | seen, again | twice | (before & seen)
            pages[page] = seen, twice
    for page, (_, twice) in pages.items():
        if twice.any():
            yield pa.RecordBatch.from_pydict({"page": pa.array([page], pa.int32()), "blocks": pa.array([twice.view(np.int64)], pa.list_(pa.int64()))})


def _repeated(digests: DataFrame, bits: int, count: int) -> DataFrame:
    """Filter of the digests that may occur more than once, from ``count`` values of a column ``digest``.

    A task holds two filters, the shuffle the touched pages of each task.
    """
    tasks = digests.select("digest").coalesce(-(-max(count, 1) // KEYS_A_TASK))
    pages = tasks.mapInArrow(lambda batches: _two_filters(batches, bits), "page int, seen binary, twice binary")
    return pages.repartition("page").mapInArrow(_merged, "page int, blocks array<long>")


def _order() -> Column:
    """What the row that stays has least of."""
    return F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def copies(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    text = F.col("text")
    sha = F.sha2(normalised(text), 256)
    narrow = documents.select("doc_id", sha.alias("text_sha256"), F.length(F.coalesce(text, F.lit(""))).alias("n_points"))
    narrow = stage(narrow.withColumn("row", F.monotonically_increasing_id()), "dedup")
    narrow = narrow.withColumn("digest", F.xxhash64("text_sha256"))
    count = narrow.count()
    bits = bloom.page_bits(count)
    pages = stage(_repeated(narrow, bits, count), "dedup-filter")
    flagged = bloom.ask(narrow, "digest", pages, bits, "maybe").drop("digest")
    through = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shuffled = flagged.where("maybe")
    groups = shuffled.groupBy("text_sha256").agg(F.min(_order()).alias("best"), F.count("*").alias("group_size"))
    groups = stage(groups.select("text_sha256", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "dedup-groups")
    decided = shuffled.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return through.unionByName(decided)


def distinct_documents(documents: DataFrame) -> DataFrame:
    """The rows that stay, all their columns unchanged. Only rows the filter flags shuffle.

    Equal rows meet before the shuffle, so that a group of copies sends one row a task.
    """
    names = documents.columns
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    rows = documents.select(whole.alias("whole"), "doc_id", "text")
    digests = stage(documents.select(F.xxhash64(normalised(F.col("text"))).alias("digest")), "dedup-digests")
    count = digests.count()
    bits = bloom.page_bits(count)
    pages = stage(_repeated(digests, bits, count), "dedup-filter")
    flagged = bloom.ask(rows.withColumn("digest", F.xxhash64(normalised(F.col("text")))), "digest", pages, bits, "maybe")
    sha = F.sha2(normalised(F.col("text")), 256)
    shuffled = flagged.where("maybe").select("whole", "doc_id", sha.alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), F.xxhash64("text").alias("row"))
    kept = shuffled.groupBy("text_sha256").agg(F.min_by("whole", _order()).alias("whole")).select("whole")
    out = flagged.where("not maybe").select("whole").unionByName(kept)
    return out.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(names)])
