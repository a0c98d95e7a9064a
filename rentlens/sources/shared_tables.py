"""Listing, request and page tables derived from the shared test tables.

The column expressions are valid unchanged in Spark SQL and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RENT = "cast(cast(floor(o_totalprice/50) as int) as varchar(20))"

LISTING_COLUMNS = {
    "listing_id": "o_orderkey",
    "city": "r_name",
    "district": "n_name",
    "location": "concat('Khan ', n_name, ', ', r_name)",
    "property_type": (
        "case o_orderkey % 13 when 0 then 'Villa' when 1 then ' villa ' when 2 then 'TWIN VILLA' "
        "when 3 then 'condo' when 4 then 'Apartment' when 5 then 'link house' when 6 then 'Shophouse' "
        "when 7 then 'flat' when 8 then 'House' when 9 then 'Room' when 10 then 'Townhouse' "
        "when 11 then null else 'Villa' end"
    ),
    "rent_price_usd": (
        "case when o_orderkey % 19 = 0 then 'POA' when o_orderkey % 23 = 0 then null "
        f"when o_orderkey % 3 = 0 then concat('$', {_RENT}, '/month') else {_RENT} end"
    ),
    "size_sqm": (
        "case when o_orderkey % 11 = 0 then null "
        "else concat(cast(20 + (o_orderkey * 7) % 480 as varchar(20)), ' m²') end"
    ),
    "bedrooms": (
        "case when o_orderkey % 9 = 0 then null "
        "else concat(cast((o_orderkey * 3 + o_custkey) % 9 as varchar(20)), ' bedrooms') end"
    ),
    "bathrooms": (
        "case when o_orderkey % 10 = 0 then null "
        "else cast(1 + (o_orderkey + o_custkey) % 7 as varchar(20)) end"
    ),
    "furnished": (
        "case o_orderpriority when '1-URGENT' then 'fully furnished' when '2-HIGH' then 'Furnished' "
        "when '3-MEDIUM' then 'unfurnished' when '4-NOT SPECIFIED' then null else '' end"
    ),
    "posted_date": "cast(o_orderdate as date)",
    "title": "concat('house for ', case when o_orderkey % 29 = 0 then 'sale' else 'rent' end)",
    "source_url": "concat('https://example.com/adid-', cast(o_orderkey as varchar(20)))",
}

LISTINGS_SQL = (
    "SELECT " + ", ".join(f"{e} AS {c}" for c, e in LISTING_COLUMNS.items()) + " FROM orders "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings_from(orders: DataFrame, spark: SparkSession, sf_dir: str, extra=()) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.selectExpr(*[f"{e} AS {c}" for c, e in LISTING_COLUMNS.items()], *extra)


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw listing per order."""
    return listings_from(table(spark, sf_dir, "orders"), spark, sf_dir)


def listings_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing once per line item of its order: natural full-row copies."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    raw = listings_raw(spark, sf_dir)
    return raw.join(lines, F.col("listing_id") == F.col("l_orderkey")).drop("l_orderkey")
