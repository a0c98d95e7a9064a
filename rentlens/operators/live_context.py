"""Market context kept up to date from stored sketches.

The exact context reads every listing again. Here a folder keeps, for each batch of listings, the sketches
of all context measures by day and group. A refresh sketches the new listings only, merges what is stored
and reads the same figures out of the merged sketches, each within the stated rank error.

The context leaves out the tails of the rent, whose limits move as listings come in. So sketches are kept by
rent band: the first batch sets edges at several ranks around each limit, the middle of the market is one
band. A refresh leaves out whole bands, cut at the edge whose rank is nearest to the limit, and reports these
ranks; edges that have drifted too far from the limits are an error that asks for a new start.

A batch is written under its name, and writing it again replaces it, so a repeated run counts nothing twice.
Listings without a rent above 0 are left out, as in the exact context; null days are a day of their own. An empty
batch adds nothing; a folder without listings gives the default figures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.operators import sketches as K
from rentlens.operators.context import MarketContext, context_tables, market_rows, room_bucket, valid_pps
from rentlens.operators.quantiles import scoped_measures
from rentlens.session import stage

LOW, HIGH = 0.01, 0.99
# ranks of the band edges around each limit
TAIL_RANKS = [round(0.002 * i, 3) for i in range(1, 11)]
CELL = ["day", "band", "scope", "key", "measure"]
_SCHEMA = "day date, band int, scope string, key string, measure string, sketch binary, n long"


class DriftedEdges(ValueError):
    """The tails of the market have left the band edges; start anew from the listings."""


@dataclass
class LiveMarket:
    """Merged figures in the shape of the exact context's ``market_points``, and the ranks of the cuts."""

    points: DataFrame
    low: float
    high: float
    low_rank: float
    high_rank: float

    def context(self) -> MarketContext:
        points = stage(self.points, "live-points")
        return MarketContext({name: stage(t, name) for name, t in context_tables(points).items()})


def _measures() -> dict[str, tuple[Column, dict[str, Column]]]:
    """Key and measures of each scope of the context."""
    rent, none = F.col("rent"), F.lit(None).cast("string")
    pps = valid_pps(rent, F.col("size_sqm"))
    complete = F.col("size_sqm").isNotNull() & F.col("bedrooms").isNotNull() & F.col("bathrooms").isNotNull()
    dates = ("post_month", "post_dayofweek", "post_quarter")
    return {
        "all": (none, {"rent": rent, "pps": pps} | {c: F.col(c) for c in (*vocab.STRUCTURAL, *dates)}),
        "district": (F.col("district_key"), {"rent": rent}),
        "type": (F.col("kind"), {"rent": rent, "pps": pps} | {c: F.when(complete, F.col(c)) for c in vocab.STRUCTURAL}),
        "bedrooms": (room_bucket(F.col("bedrooms"), 0).cast("string"), {"rent": F.when(F.col("bedrooms").isNotNull(), rent)}),
        "bathrooms": (room_bucket(F.col("bathrooms"), 1).cast("string"), {"rent": F.when(F.col("bathrooms").isNotNull(), rent)}),
    }


def _band(edges: list[float]) -> Column:
    """Number of edges at or below the rent."""
    count = F.lit(0)
    for edge in edges:
        count = count + (F.col("rent") >= edge).cast("int")
    return count


def _rows(df: DataFrame, day: str | None, **options) -> DataFrame:
    day_column = F.lit(None).cast("date") if day is None else F.try_to_timestamp(F.col(day).cast("string")).cast("date")
    return market_rows(df.withColumn("market_day", day_column), keep=["market_day"], **options).withColumnRenamed("market_day", "day")


def batch_sketches(rows: DataFrame, edges: list[float], accuracy: float) -> DataFrame:
    """Sketches of one batch of market rows by day, band, scope, key and measure.

    One aggregate a scope over the narrow stored rows; nothing is multiplied before it is added up.
    """
    k = F.lit(K.sketch_size(accuracy))
    banded = rows.withColumn("band", _band(edges))
    parts = []
    for scope, (key, measures) in _measures().items():
        aggregates = []
        for name, value in measures.items():
            v = value.cast("double")
            aggregates += [F.kll_sketch_agg_double(v, k).alias(f"s_{name}"), F.count(v).alias(f"n_{name}")]
        cells = banded.groupBy("day", "band", key.alias("key")).agg(*aggregates)
        long = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"s_{m}").alias("sketch"), F.col(f"n_{m}").alias("n")) for m in measures])
        parts.append(cells.select("day", "band", F.lit(scope).alias("scope"), "key", F.inline(long)).where("n > 0"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def long_measures(rows: DataFrame) -> DataFrame:
    """The rows' own values in long form ``scope, key, measure, v``, to judge the sketches by."""
    return scoped_measures(rows, [(scope, key, m, v) for scope, (key, measures) in _measures().items() for m, v in measures.items()])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{path}/sketches/*")


def _settings(spark: SparkSession, path: str) -> tuple[list[float], float]:
    row = spark.read.parquet(f"{path}/settings").first()
    return list(row["edges"]), row["accuracy"]


def tail_edges(rows: DataFrame, accuracy: float) -> list[float]:
    """Distinct rents at the ranks around both limits; none for an empty market."""
    ranks = [*TAIL_RANKS, *[round(1 - r, 3) for r in reversed(TAIL_RANKS)]]
    found = K.quantiles_by_sketch(rows, [], ranks, "rent", accuracy).select("quantile").distinct()
    return sorted(r[0] for r in found.take(len(ranks)))


def add(spark: SparkSession, df: DataFrame, path: str, batch: str, day: str | None = "posted_date", **options) -> None:
    """Sketch a batch of new clean listings and store it under its name; only these listings are read."""
    edges, accuracy = _settings(spark, path)
    rows = stage(_rows(df, day, **options), "live-rows")
    batch_sketches(rows, edges, accuracy).select(*CELL, "sketch", "n").write.mode("overwrite").parquet(f"{path}/sketches/batch-{batch}")


def start(
    spark: SparkSession, df: DataFrame, path: str, batch: str, accuracy: float = 0.005, edges: list[float] | None = None,
    day: str | None = "posted_date", **options,
) -> None:
    """Set the band edges from the first batch, unless given, and store its sketches."""
    rows = stage(_rows(df, day, **options), "live-rows")
    edges = tail_edges(rows, min(accuracy, 0.001)) if edges is None else edges
    spark.createDataFrame([(edges, accuracy)], "edges array<double>, accuracy double").coalesce(1).write.parquet(f"{path}/settings")
    batch_sketches(rows, edges, accuracy).select(*CELL, "sketch", "n").write.mode("overwrite").parquet(f"{path}/sketches/batch-{batch}")


def _cuts(rents: DataFrame, edges: list[float]) -> tuple[int, int, float, float]:
    """First band kept, first band no more kept, and the share of rows below each of the two cuts."""
    shares = F.array(*[F.kll_sketch_get_rank_double("sketch", F.lit(e)) for e in edges]) if edges else F.array().cast("array<double>")
    row = rents.select(shares.alias("ranks")).first()
    if row is None or not edges:
        return 0, len(edges) + 1, 0.0, 1.0
    low = min(range(len(edges)), key=lambda i: abs(row["ranks"][i] - LOW))
    high = min(range(len(edges)), key=lambda i: abs(row["ranks"][i] - HIGH))
    return low + 1, max(high, low) + 1, row["ranks"][low], row["ranks"][high]


def market(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, max_drift: float = 0.01) -> LiveMarket:
    """Figures merged from all stored batches, or from the days ``since <= day < until``.

    Nothing but sketches is read. ``max_drift`` bounds the distance of the cut's rank from the limit.
    """
    edges, accuracy = _settings(spark, path)
    cells = _stored(spark, path)
    for bound, inside in ((since, F.col("day") >= F.lit(since)), (until, F.col("day") < F.lit(until))):
        cells = cells if bound is None else cells.where(inside)
    rents = K.merged(cells.where("scope = 'all' AND measure = 'rent'"), [])
    first, last, low_rank, high_rank = _cuts(rents, edges)
    # a rent that very many listings share can hold a limit within its ranks; only spread rents can drift
    if edges and max(abs(low_rank - LOW), abs(high_rank - HIGH)) > max_drift + K.rank_error(K.sketch_size(accuracy)) and len(edges) == 2 * len(TAIL_RANKS):
        raise DriftedEdges(f"cuts at ranks {low_rank:.4f} and {high_rank:.4f}")
    kept = K.merged(cells.where(F.col("band").between(first, last - 1)), ["scope", "key", "measure"])
    spread = (F.col("scope") == "all") & (F.col("measure") == "pps")
    points = K.read_quantiles(kept, [0.1, 0.5, 0.9]).where(spread | (F.col("prob") == 0.5)).withColumnRenamed("n", "group_n")
    low = edges[first - 1] if first else float("-inf")
    high = edges[last - 1] if last <= len(edges) else float("inf")
    return LiveMarket(points.select("scope", "key", "measure", "prob", "quantile", "group_n"), low, high, low_rank, high_rank)


def listing_counts(spark: SparkSession, path: str) -> DataFrame:
    """``scope, key, measure, n`` of everything stored, tails included."""
    return _stored(spark, path).groupBy("scope", "key", "measure").agg(F.sum("n").alias("n"))


def refresh(spark: SparkSession, df: DataFrame, path: str, batch: str, **options) -> MarketContext:
    """Add a batch and give the context of everything stored."""
    add(spark, df, path, batch, **options)
    return market(spark, path).context()
