"""Chat formatting: collapse cumulative snapshots, then render each conversation that remains.

A conversation logged again after each turn leaves snapshots that are prefixes of the longest log. Every
prefix of a conversation has a rolling digest, running sums of two 64-bit digests of turn number, role and
text. Equal conversations count once, under the smallest id; an anti-join against the proper prefixes of
all conversations leaves the maximal ones, and only those are rendered.

Sums run first over chunks of turns and then inside each chunk, so that one conversation with very many
turns is spread over tasks until it is rendered. Rows without ``conv_id`` are one conversation. Null turns
come last; rows that share a turn belong together and are rendered in order of role and text, repeated
rows each time. A null role shows as ``unknown``, a null text as empty; marker openings inside a text are
broken up so that no text can start a turn. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.session import stage

CHUNK = 64
_SUM = "decimal(38,0)"
LAST = 9223372036854775807  # fixed value: where null turns go


def prefix_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``n``, ``a``, ``b`` of the prefix up to each turn, and ``last``: whether it is the whole."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(LAST))
    digest = lambda *seed: F.xxhash64(*seed, turn, F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))).cast(_SUM)
    rows = conversations.select("conv_id", turn.alias("turn"), F.floor(turn / CHUNK).alias("chunk"), digest(F.lit(1)).alias("a"), digest(F.lit(2)).alias("b"))
    sums = [F.sum(F.col(c)).cast(_SUM).alias(c) for c in ("a", "b")]
    turns = stage(rows.groupBy("conv_id", "chunk", "turn").agg(F.count("*").alias("n"), *sums), "chat-turns")
    chunks = turns.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n"), *sums, F.max("turn").alias("end"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    start = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "a", "b")]
    chunks = chunks.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), *start, F.max("end").over(whole).alias("end"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = turns.select("conv_id", "chunk", "turn", *[F.sum(c).over(inside).alias(c) for c in ("n", "a", "b")])
    joined = running.join(chunks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    total = [(F.col(c) + F.col(f"{c}0")).cast("long" if c == "n" else _SUM).alias(c) for c in ("n", "a", "b")]
    return joined.select("conv_id", "turn", *total, (F.col("turn") == F.col("end")).alias("last"))


def maximal(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` of the conversations that are neither prefix nor copy of another."""
    digests = stage(prefix_digests(conversations), "chat-prefixes")
    smallest = F.min(F.struct(F.col("conv_id").isNull().alias("unknown"), "conv_id")).alias("first")
    whole = digests.where("last").groupBy("n", "a", "b").agg(smallest)
    shorter = digests.where("not last").select("n", "a", "b").distinct()
    return whole.join(shorter, ["n", "a", "b"], "left_anti").select(F.col("first.conv_id").alias("conv_id"), F.col("n").alias("n_turns"))


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def render(conversations: DataFrame, opening: str = "<|", closing: str = "|>\n", end: str = "\n<|end|>\n") -> DataFrame:
    """``conv_id`` and ``chat``: the maximal conversations as one text each, with ``n_turns``."""
    kept = maximal(conversations).select(F.col("conv_id").alias("_conv"), "n_turns")
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select("conv_id", turn.alias("said")).join(kept, F.col("conv_id").eqNullSafe(F.col("_conv")))
    one = lambda t: F.concat(F.lit(opening), _safe(t["role"]), F.lit(closing), _safe(t["text"]), F.lit(end))
    chats = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return chats.select("conv_id", "n_turns", F.array_join(F.transform("said", one), "").alias("chat"))
