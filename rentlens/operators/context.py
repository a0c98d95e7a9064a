"""Market context: the small tables that scoring looks prices up in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.functions.numeric import clip, date_parts, round_even, within
from rentlens.operators import clean as C
from rentlens.operators.lookup import fits_broadcast
from rentlens.operators.quantiles import quantile_table, quantiles_long, scoped_measures
from rentlens.session import stage

MAX_BUCKET = 12  # room counts above share one bucket


def running_max(df: DataFrame, key: str, value: str, name: str = "monotone") -> DataFrame:
    """Largest value up to each key, for a table of at most ``MAX_BUCKET + 1`` rows."""
    upto = W.orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(upto))


def room_bucket(c: Column, lowest: int) -> Column:
    return clip(round_even(c), F.lit(float(lowest)), F.lit(float(MAX_BUCKET))).cast("int")


def nearest_bucket(c: Column, buckets: Sequence[tuple[int, float]], lowest: int) -> Column:
    """Price of the bucket nearest to a rounded room count; ties go to the smaller bucket.

    The nearest bucket is looked up for every count up to the largest bucket; beyond it the largest
    bucket is the nearest.
    """
    if not buckets:
        return F.lit(None).cast("double")
    buckets = sorted(buckets)
    top = buckets[-1][0]
    nearest = [min(buckets, key=lambda b: (abs(b[0] - t), b[0]))[1] for t in range(top + 1)]
    target = within(F.rint(c), float(lowest), float(top)).cast("int")
    return F.when(c.isNotNull(), F.get(F.array(*[F.lit(float(p)) for p in nearest]), target))


def market_rows(
    df: DataFrame, kind=T.model_type, token_groups=None, scoped: bool = True, sale_filter: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Listings the context is measured on, before the tails are trimmed, with the columns ``keep``."""
    df = C.with_defaults(df, {"district": F.lit(None).cast("string"), "title": F.lit(None).cast("string"),
                              "posted_date": F.lit(None).cast("string")})
    df = C.numeric_columns(df, [vocab.TARGET, *vocab.STRUCTURAL]).where(F.col(vocab.TARGET) > 0)
    if scoped:
        df = C.scope_filter(df, "district", token_groups)
    if sale_filter:
        df = C.drop_sale_like(df)
    return df.select(
        T.place_key(F.col("district")).alias("district_key"), kind(F.col("property_type")).alias("kind"),
        F.col(vocab.TARGET).alias("rent"), *vocab.STRUCTURAL,
        *[c.alias(n) for n, c in date_parts(F.col("posted_date")).items()], *keep,
    )


def trim_tails(df: DataFrame, column: str = "rent", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two quantiles. The two numbers are read first, so that the filter reaches the scan."""
    cut = quantile_table(df, [], {"low": (column, low), "high": (column, high)}).first()
    if cut["low"] is None:
        return df.where(F.lit(False))
    return df.where(F.col(column).between(cut["low"], cut["high"]))


def valid_pps(rent: Column, size: Column) -> Column:
    pps = rent / size
    return F.when((size > 5) & (rent > size * 0.5) & (rent < size * 300.0), pps)


def market_points(rows: DataFrame) -> DataFrame:
    """All quantiles of the context in one pass: ``scope, key, measure, prob, quantile, group_n``."""
    rent, none = F.col("rent"), F.lit(None).cast("string")
    pps = valid_pps(rent, F.col("size_sqm"))
    complete = F.col("size_sqm").isNotNull() & F.col("bedrooms").isNotNull() & F.col("bathrooms").isNotNull()
    parts = [("all", none, "rent", rent), ("all", none, "pps", pps)]
    parts += [("all", none, c, F.col(c)) for c in (*vocab.STRUCTURAL, "post_month", "post_dayofweek", "post_quarter")]
    parts += [("district", F.col("district_key"), "rent", rent), ("type", F.col("kind"), "rent", rent),
              ("type", F.col("kind"), "pps", pps)]
    parts += [("type", F.col("kind"), c, F.when(complete, F.col(c))) for c in vocab.STRUCTURAL]
    parts += [("bedrooms", room_bucket(F.col("bedrooms"), 0), "rent", F.when(F.col("bedrooms").isNotNull(), rent)),
              ("bathrooms", room_bucket(F.col("bathrooms"), 1), "rent", F.when(F.col("bathrooms").isNotNull(), rent))]
    spread = (F.col("scope") == "all") & (F.col("measure") == "pps")
    probs = F.when(spread, F.array(*map(F.lit, (0.1, 0.5, 0.9)))).otherwise(F.array(F.lit(0.5)))
    return quantiles_long(scoped_measures(rows, parts), ["scope", "key", "measure"], probs)


def _value(measure: str, prob: float = 0.5, column: str = "quantile") -> Column:
    return F.max(F.when((F.col("measure") == measure) & (F.col("prob") == prob), F.col(column)))


def district_table(points: DataFrame) -> DataFrame:
    """``district_key, n, freq, district_price``."""
    rows = points.where((F.col("scope") == "all") & (F.col("measure") == "rent")).agg(F.max("group_n")).scalar()
    return points.where(F.col("scope") == "district").select(
        F.col("key").alias("district_key"), F.col("group_n").alias("n"), (F.col("group_n") / rows).alias("freq"),
        F.col("quantile").alias("district_price"),
    )


def type_table(points: DataFrame) -> DataFrame:
    """``kind, n, type_price, type_pps`` and the median profile of the type."""
    out = points.where(F.col("scope") == "type").groupBy(F.col("key").alias("kind")).agg(
        _value("rent", column="group_n").alias("n"), _value("rent").alias("type_price"), _value("pps").alias("type_pps"),
        *[_value(c).alias(f"profile_{c}") for c in vocab.STRUCTURAL],
    )
    rooms = clip(F.col("profile_bedrooms") + F.col("profile_bathrooms"), lo=1.0)
    return out.withColumn("profile_size_per_room", F.col("profile_size_sqm") / rooms)


def bucket_table(points: DataFrame, scope: str) -> DataFrame:
    """``bucket, price, monotone`` of a room count, at most ``MAX_BUCKET + 1`` rows."""
    rows = points.where(F.col("scope") == scope).select(
        F.col("key").cast("int").alias("bucket"), F.col("quantile").alias("price")
    )
    return running_max(rows, "bucket", "price")


def overall_table(points: DataFrame) -> DataFrame:
    """One row of market-wide figures; a figure without data takes its default."""
    d = {k: F.lit(v) for k, v in vocab.CONTEXT_DEFAULTS.items()}
    row = points.where(F.col("scope") == "all").agg(
        _value("rent").alias("overall_price"), _value("pps").alias("overall_pps"),
        _value("pps", 0.1).alias("low"), _value("pps", 0.9).alias("high"),
        _value("size_sqm").alias("overall_size"), _value("bedrooms").alias("overall_bed"),
        _value("bathrooms").alias("overall_bath"),
        *[_value(c).alias(c) for c in ("post_month", "post_dayofweek", "post_quarter")],
    )
    spread = F.col("high") > F.col("low")
    kinds = points.where((F.col("scope") == "type") & (F.col("measure") == "rent"))
    best = kinds.agg(F.min_by("key", F.struct((-F.col("group_n")).alias("n"), "key")).alias("k")).scalar()
    plain = [c for c in row.columns if c not in ("low", "high")]
    return row.select(
        *[F.coalesce(F.col(c), d[c]).alias(c) for c in plain],
        F.when(spread, F.col("low")).otherwise(d["pps_low"]).alias("pps_low"),
        F.when(spread, F.col("high")).otherwise(d["pps_high"]).alias("pps_high"),
        F.coalesce(best, d["dominant_type"]).alias("dominant_type"),
    )


def contrast_type(types: DataFrame, dominant: str) -> DataFrame:
    """The type whose price is furthest from the dominant type's; ties alphabetical."""
    price = types.where(F.col("kind") == dominant).agg(F.max("type_price")).scalar()
    order = F.struct((-F.abs(F.col("type_price") - price)).alias("gap"), F.col("kind").alias("name"))
    return types.where(F.col("kind") != dominant).agg(F.min_by("kind", order).alias("contrast_type"))


def top_regions(districts: DataFrame, n: int = 6) -> DataFrame:
    """Dearest districts, title-cased; a blank key takes a place but is not shown."""
    top = districts.orderBy(F.desc("district_price"), "district_key").limit(n).where(F.col("district_key") != "")
    return top.select(T.title_case(F.col("district_key")).alias("location"),
                      round_even(F.col("district_price"), 2).alias("price"))


TABLES = ("district", "type", "bedrooms", "bathrooms", "overall", "regions")


@dataclass
class MarketContext:
    """Stored context tables and, on the driver, the figures of fixed size: one row of overall
    figures, at most 13 prices per room bucket, six regions."""

    tables: dict[str, DataFrame]
    overall: dict[str, object] = field(init=False)
    buckets: dict[str, list[tuple[int, float]]] = field(init=False)
    regions: list[tuple[str, float]] = field(init=False)

    def __post_init__(self):
        self.overall = self.tables["overall"].first().asDict()
        self.buckets = {
            name: [(r["bucket"], r["monotone"]) for r in self.tables[name].sort("bucket").take(MAX_BUCKET + 1)]
            for name in ("bedrooms", "bathrooms")
        }
        regions = self.tables["regions"].sort(F.desc("price"), "location").take(6)
        self.regions = [(r["location"], r["price"]) for r in regions]
        self.small_districts = fits_broadcast(self.tables["district"])
        self.small_types = fits_broadcast(self.tables["type"])
        self.has_types = bool(self.tables["type"].take(1))
        self.contrast = contrast_type(self.tables["type"], self.overall["dominant_type"]).first()[0]


def context_tables(points: DataFrame) -> dict[str, DataFrame]:
    districts = district_table(points)
    return {
        "district": districts,
        "type": type_table(points),
        "bedrooms": bucket_table(points, "bedrooms"),
        "bathrooms": bucket_table(points, "bathrooms"),
        "overall": overall_table(points),
        "regions": top_regions(districts),
    }


def build_context(df: DataFrame, **options) -> MarketContext:
    """Measure the market on clean listings. The listings are read into one narrow stored table, and
    all quantiles of the context come from one pass over it."""
    rows = trim_tails(stage(market_rows(df, **options), "market"))
    points = stage(market_points(rows), "points")
    return MarketContext({name: stage(t, name) for name, t in context_tables(points).items()})


def save_context(context: MarketContext, path: str) -> None:
    for name, table in context.tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_context(spark: SparkSession, path: str) -> MarketContext:
    return MarketContext({name: spark.read.parquet(f"{path}/{name}") for name in TABLES})
