"""Resolve free-text places to known district keys."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.operators.clean import evaluate_once
from rentlens.operators.lookup import fits_broadcast, lookup_join
from rentlens.session import stage

_MAX_GRAM = 4
_ROUNDING = 1e-9


@F.pandas_udf(DoubleType())
def similarity(key: pd.Series, text: pd.Series) -> pd.Series:
    """Share of matching characters of two texts, by longest matching blocks."""
    ratio = difflib.SequenceMatcher()
    out = []
    for k, t in zip(key, text, strict=True):
        ratio.set_seqs(k, t)
        out.append(ratio.ratio())
    return pd.Series(out, dtype="float64")


def _grams(c: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def _pieces(c: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[_grams(c, n) for n in range(1, _MAX_GRAM + 1)])))


def _contained(inner: DataFrame, inner_col: str, outer: DataFrame, outer_col: str) -> DataFrame:
    """Pairs where the text ``inner_col`` is a part of ``outer_col``.

    All pieces of the inner text are pieces of the outer one. The inner text is looked up by the piece that
    fewest outer texts have, which makes the search an equi-join without hot keys of common beginnings.
    """
    c = F.col(inner_col)
    own = F.array_distinct(F.when(F.length(c) >= _MAX_GRAM, _grams(c, _MAX_GRAM)).otherwise(F.array(c)))
    right = stage(outer.withColumn("piece", F.explode(_pieces(F.col(outer_col)))), "pieces")
    counts = right.groupBy("piece").agg(F.count("*").alias("texts"))
    asked = inner.withColumn("piece", F.explode(own)).join(counts, "piece", "left")
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("rarest")
    asked = asked.groupBy(*inner.columns).agg(rarest).where("rarest.texts > 0").withColumn("piece", F.col("rarest.piece")).drop("rarest")
    return asked.join(right, "piece").where(F.contains(F.col(outer_col), c)).drop("piece")


def _most_alike(a: Column, b: Column) -> Column:
    """Upper bound of the similarity: the share of characters that both texts have, in any order."""
    times = lambda text, char: F.length(text) - F.length(F.replace(text, char, F.lit("")))
    both = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, char: n + F.least(times(a, char), times(b, char)))
    return both * 2.0 / (F.length(a) + F.length(b))


def _first_key(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("text").agg(F.min_by("district_key", "position").alias("district_key"))


def _counted_characters(texts: DataFrame, name: str) -> DataFrame:
    """``name, piece``: every character of a text with the number of its occurrence, so that texts are sets."""
    characters = texts.select(name, F.explode(_grams(F.col(name), 1)).alias("char")).groupBy(name, "char").agg(F.count("*").alias("n"))
    numbered = characters.select(name, "char", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    return numbered.select(name, F.concat("char", F.col("k").cast("string")).alias("piece"))


def _prefixes(pieces: DataFrame, counts: DataFrame, name: str, cutoff: float) -> DataFrame:
    """``name, piece, place``: the rarest pieces of each text, as many as it can need to meet a similar one."""
    size = F.length(name)
    ranked = lookup_join(pieces, counts, ["piece"]).withColumn(
        "place", F.row_number().over(W.partitionBy(name).orderBy("texts", "piece")))
    least = F.ceil(size * (cutoff / (2 - cutoff)) - _ROUNDING)
    return ranked.where(F.col("place") <= size - least + 1).select(name, "piece", "place")


def similar_candidates(texts: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """Distinct pairs ``text, key_text`` that can reach the cutoff, found by prefix filter.

    Texts of ``n`` characters together are similar only if they share ``cutoff * n / 2`` of them. With the
    pieces of both in one order, rarest first, such texts share a piece among the first ``length - shared + 1``
    of either, so only these are joined; their places and both lengths are part of the join. Characters that
    all texts have stand at the end of the order, where no pair is looked up by them. Nothing longer than a
    character is sure to be shared at the usual cutoff, so texts over a small alphabet still meet many others.
    """
    left = stage(_counted_characters(texts.select("text"), "text"), "text-pieces")
    right = stage(_counted_characters(keys.select("key_text").distinct(), "key_text"), "key-pieces")
    counts = stage(left.select("piece").unionAll(right.select("piece")).groupBy("piece").agg(F.count("*").alias("texts")), "piece-counts")
    x, y = _prefixes(left, counts, "text", cutoff), _prefixes(right, counts, "key_text", cutoff).withColumnRenamed("place", "key_place")
    shared = F.ceil((F.length("text") + F.length("key_text")) * (cutoff / 2) - _ROUNDING)
    inside = (F.col("place") <= F.length("text") - shared + 1) & (F.col("key_place") <= F.length("key_text") - shared + 1)
    return x.join(y, "piece").where(inside).select("text", "key_text").distinct()


def _similar(texts: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """Most similar key of each text at or above ``cutoff``; ties go to the larger key text."""
    pairs = similar_candidates(texts, keys, cutoff).where(_most_alike(F.col("text"), F.col("key_text")) >= cutoff)
    scored = pairs.withColumn("ratio", similarity("key_text", "text")).where(F.col("ratio") >= cutoff)
    best = scored.groupBy("text").agg(F.max_by("key_text", F.struct("ratio", "key_text")).alias("key_text"))
    return lookup_join(best, keys.select("key_text", "district_key"), ["key_text"]).select("text", "district_key")


def key_texts(districts: DataFrame) -> DataFrame:
    """Cleaned text of each district key; ``position`` orders keys by rows, then by name."""
    order = F.struct((-F.col("n")).alias("rows"), F.col("district_key").alias("name"))
    return (
        districts.select(T.geo_clean(F.col("district_key")).alias("key_text"), "district_key", order.alias("position"))
        .groupBy("key_text")
        .agg(F.max_by("district_key", "position").alias("district_key"), F.min("position").alias("position"))
    )


def match_texts(texts: DataFrame, keys: DataFrame, cutoff: float | None = vocab.FUZZY_CUTOFF) -> DataFrame:
    """District key of each distinct cleaned text: equal, else contained either way, else similar."""
    found = texts.join(keys.withColumnRenamed("key_text", "text"), "text", "left").select("text", "district_key")
    found = stage(found, "found")
    exact = found.where(F.col("district_key").isNotNull())
    rest = found.where(F.col("district_key").isNull()).select("text")
    if rest.isEmpty():
        return exact
    both = _contained(rest, "text", keys, "key_text").unionByName(_contained(keys, "key_text", rest, "text"))
    partial = _first_key(both)
    if cutoff is None:
        return exact.unionByName(partial)
    partial = stage(partial, "partial")
    return exact.unionByName(partial).unionByName(_similar(rest.join(partial, "text", "left_anti"), keys, cutoff))


def resolve_district(
    df: DataFrame,
    districts: DataFrame,
    columns: Sequence[str] = ("district", "location", "city"),
    cutoff: float | None = vocab.FUZZY_CUTOFF,
    scoped_to=None,
) -> DataFrame:
    """Add ``district_key``: the first of ``columns`` that resolves to a key of ``districts``.

    ``districts`` has ``district_key`` and its number of rows ``n``. Only distinct texts are cleaned and matched.
    With token groups in ``scoped_to``, a district in that scope takes every row.
    """
    keys = stage(key_texts(districts), "keys")
    given = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("given")).distinct()
    given = stage(evaluate_once(given, {"text": T.geo_clean(F.col("given"))}).where(F.col("text") != ""), "given")
    found = stage(match_texts(given.select("text").distinct(), keys, cutoff), "found")
    matched = stage(given.join(found, "text").select("given", "district_key"), "matched")
    small = fits_broadcast(matched)
    out = df
    for c in columns:
        part = matched.select(F.col("given").alias(f"text_{c}"), F.col("district_key").alias(f"match_{c}"))
        out = lookup_join(out.withColumn(f"text_{c}", F.col(c).cast("string")), part, [f"text_{c}"], small=small)
    key = F.coalesce(*[F.col(f"match_{c}") for c in columns], F.lit(""))
    if scoped_to is not None:
        first = districts.where(T.in_scope(F.col("district_key"), scoped_to)).agg(
            F.min_by("district_key", F.struct((-F.col("n")).alias("rows"), "district_key")).alias("k")
        )
        key = F.coalesce(first.scalar(), key)
    return out.withColumn("district_key", key).drop(*[f"{s}_{c}" for c in columns for s in ("text", "match")])
