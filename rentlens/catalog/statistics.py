"""Queries of statistics, the exploratory report and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.catalog import shared as B
from rentlens.catalog import sql as Q
from rentlens.functions.numeric import round_even
from rentlens.operators import sketches as K
from rentlens.operators import stats as S
from rentlens.operators.ordinals import ordinals, plot_positions
from rentlens.operators.quantiles import quantile_table
from rentlens.plans import eda as plans
from rentlens.plans import marts
from rentlens.session import stage
from rentlens.sources.shared_tables import LISTINGS_SQL, listings_raw, listings_repeated, table

QUERIES = {}
ORACLES = {}

RENT = vocab.TARGET
WITH_CLEAN = f"WITH {Q.CLEAN} "
WITH_EDA = f"WITH {Q.EDA} "
LONG = ("long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS measure, {c}::DOUBLE AS v FROM eda" for c in vocab.EDA_NUMERIC) + ")")


def _bedrooms():
    return round_even(F.col("bedrooms")).cast("int")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH raw AS ({LISTINGS_SQL}), d AS (SELECT raw.* FROM raw JOIN lineitem ON listing_id = l_orderkey)
  SELECT 'rows' AS metric, count(*) AS value FROM d UNION ALL SELECT 'columns', 13
  UNION ALL SELECT 'duplicates', (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))""")
def overview(spark, sf_dir):
    return S.overview(listings_repeated(spark, sf_dir))


_TYPES = {
    "bigint": ["listing_id"], "date": ["posted_date"], "double": ["rent_price_usd", "size_sqm", "bedrooms", "bathrooms"],
    "string": ["city", "district", "location", "property_type", "furnished", "title", "source_url"],
    "int": ["size_sqm_was_missing", "bedrooms_was_missing", "bathrooms_was_missing"],
}


@query(WITH_CLEAN + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, (SELECT count({c if kind == 'bigint' else '*'}) FROM clean) AS rows" for kind, columns in _TYPES.items() for c in columns))
def column_types(spark, sf_dir):
    return S.column_types(B.clean(spark, sf_dir))


_NULLS = ["property_type", "rent_price_usd", "size_sqm", "bedrooms", "bathrooms", "furnished"]


@query(f"WITH raw AS ({LISTINGS_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS pct FROM raw"
    for c in _NULLS))
def null_report(spark, sf_dir):
    return B.rounded(S.null_report(listings_raw(spark, sf_dir), _NULLS))


@query(WITH_CLEAN + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", sum({c}_was_missing)::BIGINT AS imputed FROM clean" for c in vocab.STRUCTURAL))
def imputed_counts(spark, sf_dir):
    return S.imputed_counts(B.clean(spark, sf_dir), vocab.STRUCTURAL)


@query(WITH_CLEAN + "SELECT district AS key, round(median(rent_price_usd), 6) AS median FROM clean "
       "WHERE rent_price_usd IS NOT NULL GROUP BY 1")
def median_rent_by_district(spark, sf_dir):
    return B.rounded(S.group_stat(B.clean(spark, sf_dir), "district", RENT))


@query(WITH_CLEAN + "SELECT property_type AS key, round(avg(rent_price_usd), 6) AS mean FROM clean "
       "WHERE rent_price_usd IS NOT NULL GROUP BY 1")
def mean_rent_by_type(spark, sf_dir):
    return B.rounded(S.group_stat(B.clean(spark, sf_dir), "property_type", RENT, "mean"))


@query(WITH_EDA + "SELECT property_type AS key, round(median(rent_price_usd), 2) AS median FROM eda GROUP BY 1")
def median_rent_by_type(spark, sf_dir):
    """Sorted by median, as the report prints it."""
    medians = S.group_stat(B.eda(spark, sf_dir), "property_type", RENT)
    return S.round_columns(medians).orderBy(F.desc("median"), "key")


@query(WITH_EDA + "SELECT round_even(bedrooms, 0)::INT AS key, count(*) AS n FROM eda GROUP BY 1")
def bedroom_counts(spark, sf_dir):
    return S.value_counts(B.eda(spark, sf_dir), _bedrooms()).orderBy("key")


@query(WITH_CLEAN + "SELECT property_type AS key, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM clean), 2) AS pct "
       "FROM clean GROUP BY 1")
def value_shares(spark, sf_dir):
    return S.value_shares(B.clean(spark, sf_dir), "property_type")


@query(WITH_CLEAN + """SELECT listing_id, round(n / (SELECT count(*) FROM clean), 6) AS freq FROM clean
  JOIN (SELECT district AS d, count(*) AS n FROM clean GROUP BY 1) ON d = district""")
def frequency_encode(spark, sf_dir):
    return B.rounded(S.frequency_encode(B.clean(spark, sf_dir), "district").select("listing_id", "freq"))


@query(WITH_CLEAN + "SELECT property_type AS key, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, key LIMIT 1")
def dominant_value(spark, sf_dir):
    return S.dominant_value(B.clean(spark, sf_dir), "property_type")


@query(WITH_EDA + f""", {LONG} SELECT measure, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
  round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(skewness(v), 4) AS skewness,
  round(kurtosis(v), 4) AS kurtosis, skewness(v) > 1 AS log_needed FROM long GROUP BY 1""")
def moments(spark, sf_dir):
    out = B.rounded(S.moments(B.eda(spark, sf_dir), vocab.EDA_NUMERIC))
    return out.withColumns({c: F.round(c, 4) for c in ("skewness", "kurtosis")})


@query("""SELECT 'value' AS measure, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis, skewness(value) > 1 AS log_needed FROM events""")
def moments_of_events(spark, sf_dir):
    """A skewed column of another table."""
    out = B.rounded(S.moments(table(spark, sf_dir, "events"), ["value"]))
    return out.withColumns({c: F.round(c, 4) for c in ("skewness", "kurtosis")})


@query(WITH_EDA + f""", {LONG} SELECT measure, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max FROM long GROUP BY 1""")
def describe(spark, sf_dir):
    return B.rounded(S.describe(B.eda(spark, sf_dir), vocab.EDA_NUMERIC))


_PROBS = [0.01, 0.1, 0.25, 0.75, 0.9, 0.99]


@query(WITH_EDA + "SELECT 'price_per_sqm' AS measure, p::DOUBLE AS prob, round(quantile, 6) AS quantile FROM (" + " UNION ALL ".join(
    f"SELECT {p} AS p, quantile_cont(price_per_sqm, {p}) AS quantile FROM eda" for p in _PROBS) + ")")
def quantiles(spark, sf_dir):
    return B.rounded(S.quantiles(B.eda(spark, sf_dir), "price_per_sqm", _PROBS))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
  round(median(l_extendedprice), 4) AS p50, round(quantile_cont(l_quantity, 0.9), 4) AS q90 FROM lineitem GROUP BY 1""")
def quantiles_of_line_items(spark, sf_dir):
    """Quantiles of few, very large groups."""
    spec = {"p10": ("l_extendedprice", 0.1), "p50": ("l_extendedprice", 0.5), "q90": ("l_quantity", 0.9)}
    return B.rounded(quantile_table(table(spark, sf_dir, "lineitem"), ["l_returnflag"], spec), 4)


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(epoch(ts), {p}), 3) AS p{int(p * 100)}" for p in (0.01, 0.5, 0.99)) + " FROM events GROUP BY 1")
def quantiles_of_timestamps(spark, sf_dir):
    """Values that lie close together for their size, so that they share their first bucket."""
    spec = {f"p{int(p * 100)}": ("seconds", p) for p in (0.01, 0.5, 0.99)}
    events = table(spark, sf_dir, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return B.rounded(quantile_table(events, ["event_type"], spec), 3)


@query(WITH_EDA + f""", {LONG} SELECT measure, round(min(v), 6) AS min, round(max(v), 6) AS max FROM long GROUP BY 1""")
def range_summary(spark, sf_dir):
    return B.rounded(S.range_summary(B.eda(spark, sf_dir), vocab.EDA_NUMERIC))


_MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, " + ("1.0::DOUBLE" if a == b else f"corr({a}, {b})") + " AS r FROM eda"
    for a in vocab.EDA_NUMERIC for b in vocab.EDA_NUMERIC
).replace("1.0::DOUBLE AS r FROM eda", "1.0::DOUBLE AS r")


@query(WITH_EDA + f"SELECT x, y, round(r, 6) AS r FROM ({_MATRIX})")
def correlations(spark, sf_dir):
    return B.rounded(S.correlations(B.eda(spark, sf_dir), vocab.EDA_NUMERIC))


@query(WITH_EDA + f"SELECT y AS feature, round(r, 6) AS r FROM ({_MATRIX}) WHERE x = '{RENT}' AND y <> x ORDER BY r DESC LIMIT 3")
def top_correlated(spark, sf_dir):
    return B.rounded(S.top_correlated(B.eda(spark, sf_dir), vocab.EDA_NUMERIC, RENT, 3))


@query(WITH_EDA + f"""SELECT x, y, round(r, 6) AS r FROM ({_MATRIX}) WHERE abs(r) > 0.3
  AND list_position({vocab.EDA_NUMERIC}, x) < list_position({vocab.EDA_NUMERIC}, y)""")
def collinear_pairs(spark, sf_dir):
    return B.rounded(S.collinear_pairs(B.eda(spark, sf_dir), vocab.EDA_NUMERIC, 0.3))


@query(WITH_EDA + f"""SELECT 'size_sqm' AS x, '{RENT}' AS y, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t
  FROM (SELECT corr(size_sqm, {RENT}) AS r, count(*) AS n FROM eda)""")
def pearson(spark, sf_dir):
    return B.rounded(S.pearson(B.eda(spark, sf_dir), "size_sqm", RENT))


@query(WITH_EDA + f""", s AS (SELECT corr(size_sqm, {RENT}) AS r, count(*) AS n FROM eda), t AS (SELECT *, n - 2.0 AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM s),
  steps AS (SELECT i, abs(t) / 2000 AS h, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w, v FROM t, generate_series(0, 2000) AS g(i)),
  area AS (SELECT sum(w * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(i * h, 2) / v, -(v + 1) / 2)) * any_value(h) / 3 AS a FROM steps)
  SELECT 'size_sqm' AS x, '{RENT}' AS y, round(r, 6) AS r, n, round(t, 6) AS t, round(1 - 2 * a, 6) AS p FROM t, area""")
def pearson_test(spark, sf_dir):
    """With p-value; the SQL integrates the density of t."""
    return B.rounded(S.pearson_test(B.eda(spark, sf_dir), "size_sqm", RENT))


@query(WITH_EDA + f"""SELECT 'size_sqm' AS x, '{RENT}' AS y, round(regr_slope({RENT}, size_sqm), 6) AS slope,
  round(regr_intercept({RENT}, size_sqm), 6) AS intercept, round(regr_r2({RENT}, size_sqm), 6) AS r2 FROM eda""")
def regression_line(spark, sf_dir):
    return B.rounded(S.regression_line(B.eda(spark, sf_dir), "size_sqm", RENT))


@query(WITH_EDA + f""", e AS (SELECT min({RENT}) AS lo, max({RENT}) AS hi FROM eda),
  c AS (SELECT least(floor(({RENT} - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, count(*) AS n FROM eda, e GROUP BY 1)
  SELECT b AS bin, round(lo + (hi - lo) / 40 * b, 6) AS lo, round(lo + (hi - lo) / 40 * (b + 1), 6) AS hi, coalesce(n, 0) AS n
  FROM generate_series(0, 39) g(b) CROSS JOIN e LEFT JOIN c ON c.bin = b""")
def histogram(spark, sf_dir):
    return B.rounded(S.histogram(B.eda(spark, sf_dir), RENT, 40))


@query(WITH_EDA + f"""SELECT listing_id, row_number() OVER (ORDER BY listing_id) - 1 AS ordinal,
  abs({RENT} - (SELECT avg({RENT}) FROM eda)) / (SELECT stddev_samp({RENT}) FROM eda) > 3 AS outlier FROM eda""")
def row_ordinal(spark, sf_dir):
    """Position of each listing in id order, as the chart of outliers plots it."""
    return plot_positions(B.eda(spark, sf_dir), RENT, ["listing_id"])


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_discount, l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS ordinal FROM lineitem""")
def row_ordinal_of_line_items(spark, sf_dir):
    """Positions by a key of few values first; a third of all rows may share one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice")
    return ordinals(rows, ["l_discount", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "ordinal")


_GROUPED = """SELECT l_linestatus, l_returnflag, p::DOUBLE AS prob, count(*) AS n, true AS within FROM lineitem, (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS p)
  GROUP BY ALL"""


@query(_GROUPED)
def quantiles_by_sketch(spark, sf_dir):
    """Sketched quantiles by group, and whether their true ranks are within the stated half a percent."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    keys = ["l_linestatus", "l_returnflag"]
    found = K.quantiles_by_sketch(rows, keys, [0.01, 0.25, 0.5, 0.75, 0.99], "l_extendedprice", accuracy=0.005)
    return K.rank_gaps(rows, found, keys, "l_extendedprice").select(*keys, "prob", "n", (F.col("gap") <= 0.005).alias("within"))


@query("""SELECT l_linestatus, year, unnest([0.1, 0.5, 0.9])::DOUBLE AS prob, n, unnest(quantile) AS quantile FROM (
  SELECT l_linestatus, year(l_shipdate) AS year, count(*) AS n, quantile_disc(l_extendedprice, [0.1, 0.5, 0.9]) AS quantile
  FROM lineitem GROUP BY ALL)""")
def merged_sketch_quantiles(spark, sf_dir):
    """Sketches by day and group, merged by year: exact order statistics where a group is within the sketch's size."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice")
    daily = stage(K.sketched(rows, ["l_linestatus", "day"], "l_extendedprice", accuracy=0.0001), "daily-sketches")
    yearly = K.merged(daily.withColumn("year", F.year("day").cast("long")), ["l_linestatus", "year"])
    return K.read_quantiles(yearly, [0.1, 0.5, 0.9])


@query(WITH_EDA + """, e AS (SELECT min(size_sqm) AS lo, max(size_sqm) AS hi, count(*) AS n,
    stddev_samp(size_sqm) * pow(count(*), -0.2) AS w FROM eda),
  k AS (SELECT size_sqm AS v, count(*) AS k FROM eda GROUP BY 1),
  g AS (SELECT p, lo + (hi - lo) / 99 * p AS x FROM generate_series(0, 99) s(p), e)
  SELECT p AS point, round(x, 6) AS x, round(sum(k * exp(-0.5 * pow((x - v) / w, 2))) / any_value(n * w * sqrt(2 * pi())), 9) AS density
  FROM g, k, e GROUP BY p, x""")
def density(spark, sf_dir):
    out = S.density(B.eda(spark, sf_dir), "size_sqm", 100)
    return out.withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


def _box(keys: str) -> str:
    names = keys.split(", ")
    group = ", ".join(str(i + 1) for i in range(len(names)))
    same = " AND ".join(f"f.{k} = q.{k}" for k in names)
    out = ", ".join(f"q.{k}" for k in names)
    return WITH_EDA + f""", f AS (SELECT *, round_even(bedrooms, 0)::INT AS beds FROM eda),
  q AS (SELECT {keys}, quantile_cont({RENT}, 0.25) AS q1, median({RENT}) AS med, quantile_cont({RENT}, 0.75) AS q3
    FROM f GROUP BY {group}),
  x AS (SELECT f.{RENT} AS v, q.*, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM f JOIN q ON {same})
  SELECT {keys}, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
    min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high,
    count(*) FILTER (NOT inside) AS outliers, count(*) AS n FROM x GROUP BY {keys}, q1, med, q3"""


def _boxes(spark, sf_dir, keys):
    rows = B.eda(spark, sf_dir).withColumn("beds", _bedrooms())
    return B.rounded(S.box_stats(rows, keys, RENT))


@query(_box("property_type"))
def box_stats_by_type(spark, sf_dir):
    return _boxes(spark, sf_dir, ["property_type"])


@query(_box("beds"))
def box_stats_by_bedrooms(spark, sf_dir):
    return _boxes(spark, sf_dir, ["beds"])


@query(_box("property_type, beds"))
def box_stats_by_type_and_bedrooms(spark, sf_dir):
    return _boxes(spark, sf_dir, ["property_type", "beds"])


@query(WITH_EDA + f"""SELECT property_type AS "row", round_even(bedrooms, 0)::INT AS "column",
  round(median({RENT}), 6) AS median FROM eda GROUP BY 1, 2""")
def median_by_pair(spark, sf_dir):
    return B.rounded(S.median_by_pair(B.eda(spark, sf_dir), "property_type", _bedrooms(), RENT))


@query(WITH_EDA + 'SELECT property_type AS "row", ' + ", ".join(
    f"round(median({RENT}) FILTER (round_even(bedrooms, 0) = {b}), 6) AS c{b}" for b in range(9)) + " FROM eda GROUP BY 1")
def pivot_median(spark, sf_dir):
    return B.rounded(S.pivot_median(B.eda(spark, sf_dir), "property_type", _bedrooms(), RENT, range(9)))


_FENCE = WITH_EDA + """, f AS (SELECT quantile_cont(price_per_sqm, 0.25) AS q1, quantile_cont(price_per_sqm, 0.75) AS q3 FROM eda)"""


@query(_FENCE + """SELECT round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr,
  round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower, round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper,
  count(*) FILTER (price_per_sqm < q1 - 1.5 * (q3 - q1) OR price_per_sqm > q3 + 1.5 * (q3 - q1)) AS outliers,
  round(100.0::DOUBLE * count(*) FILTER (price_per_sqm < q1 - 1.5 * (q3 - q1) OR price_per_sqm > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS pct
  FROM eda, f""")
def iqr_fences(spark, sf_dir):
    return B.rounded(S.iqr_fences(B.eda(spark, sf_dir), "price_per_sqm"))


@query(WITH_EDA + """, m AS (SELECT avg(price_per_sqm) AS a, stddev_pop(price_per_sqm) AS s FROM eda)
  SELECT count(*) FILTER (abs((price_per_sqm - a) / s) > 3) AS outliers,
  round(100.0::DOUBLE * count(*) FILTER (abs((price_per_sqm - a) / s) > 3) / count(*), 6) AS pct FROM eda, m""")
def zscore_outliers(spark, sf_dir):
    return B.rounded(S.zscore_outliers(B.eda(spark, sf_dir), "price_per_sqm"))


@query(WITH_EDA + """, m AS (SELECT avg(price_per_sqm) AS a, stddev_pop(price_per_sqm) AS s FROM eda)
  SELECT listing_id, round((price_per_sqm - a) / s, 6) AS z FROM eda, m WHERE abs((price_per_sqm - a) / s) > 3""")
def zscore_outlier_rows(spark, sf_dir):
    rows = B.eda(spark, sf_dir)
    rows = rows.select("listing_id", S.zscores(rows, "price_per_sqm").alias("z"))
    return B.rounded(rows.where(F.abs("z") > 3))


def _bands(rows: str) -> str:
    edges, labels = vocab.BAND_EDGES, vocab.BAND_LABELS
    one = "SELECT {i} AS position, {l} AS \"range\", count(*) FILTER (rent_price_usd >= {a} AND rent_price_usd < {b}) AS count FROM {rows}"
    return " UNION ALL ".join(
        one.format(i=i, l=Q.q(labels[i]), a=edges[i], b=edges[i + 1], rows=rows) for i in range(len(labels))
    )


@query(WITH_CLEAN + f"SELECT position::INT AS position, \"range\", count FROM ({_bands('clean WHERE rent_price_usd > 0')})")
def price_bands(spark, sf_dir):
    return S.price_bands(B.clean(spark, sf_dir))


_PAIRS = [(a, b) for i, a in enumerate(vocab.EDA_NUMERIC) for b in vocab.EDA_NUMERIC[i + 1:]]


def _sql_bin(c: str) -> str:
    return f"least(floor(({c} - min_{c}) / ((max_{c} - min_{c}) / 20)), 19)::BIGINT"


@query(WITH_EDA + ", e AS (SELECT " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in vocab.EDA_NUMERIC)
       + " FROM eda) SELECT x, y, x_bin, y_bin, count(*) AS n FROM (" + " UNION ALL ".join(
           f"SELECT '{a}' AS x, '{b}' AS y, {_sql_bin(a)} AS x_bin, {_sql_bin(b)} AS y_bin FROM eda, e" for a, b in _PAIRS)
       + ") GROUP BY 1, 2, 3, 4")
def scatter_bins(spark, sf_dir):
    return S.scatter_bins(B.eda(spark, sf_dir), vocab.EDA_NUMERIC)


@query(WITH_EDA + f"""SELECT listing_id, size_sqm, {RENT}, property_type, bedrooms FROM eda
  ORDER BY md5(listing_id || ':42'), listing_id LIMIT 500""")
def scatter_sample(spark, sf_dir):
    return S.scatter_sample(B.eda(spark, sf_dir), "listing_id", ["size_sqm", RENT, "property_type", "bedrooms"], 500)


_SHOWN = ["listing_id", "property_type", "size_sqm", "bedrooms", "bathrooms", RENT]


@query(WITH_EDA + f"SELECT {', '.join(_SHOWN)} FROM eda ORDER BY {RENT} DESC, listing_id LIMIT 10")
def dearest_listings(spark, sf_dir):
    return S.top_n(B.eda(spark, sf_dir).select(*_SHOWN), RENT)


@query(WITH_EDA + f"SELECT {', '.join(_SHOWN)} FROM eda ORDER BY {RENT}, listing_id LIMIT 10")
def cheapest_listings(spark, sf_dir):
    return S.top_n(B.eda(spark, sf_dir).select(*_SHOWN), RENT, ascending=True)


@query(WITH_EDA + f"""SELECT 'Villa' AS segment, round(100.0::DOUBLE * count(*) FILTER (property_type = 'Villa') / count(*), 6) AS share,
  round(median({RENT}) FILTER (property_type = 'Villa'), 6) AS median FROM eda""")
def segment_share(spark, sf_dir):
    return B.rounded(S.segment_share(B.eda(spark, sf_dir), "property_type", "Villa", RENT))


@query(WITH_EDA + f"""SELECT count(*) FILTER (bedrooms >= 7 AND {RENT} >= 9000) AS large_and_dear,
  count(*) FILTER (property_type = 'Flat' AND {RENT} <= 300) AS cheap_of_type FROM eda""")
def anomaly_counts(spark, sf_dir):
    return S.anomaly_counts(B.eda(spark, sf_dir), min_bedrooms=7, min_rent=9000, cheap_rent=300)


@query(WITH_EDA + "SELECT listing_id, round(log_rent, 6) AS log_rent, round(price_per_sqm, 6) AS price_per_sqm, "
       "round(room_ratio, 6) AS room_ratio, round(total_rooms, 6) AS total_rooms FROM eda")
def prepare_eda(spark, sf_dir):
    rows = plans.prepare_eda(B.clean(spark, sf_dir))
    return B.rounded(rows.select("listing_id", "log_rent", "price_per_sqm", "room_ratio", "total_rooms"))


_CELLS = {"mean": "avg(v)", "median": "median(v)", "std": "stddev_samp(v)", "min": "min(v)", "max": "max(v)",
          "skewness": "skewness(v)", "kurtosis": "kurtosis(v)", "log_needed": "(skewness(v) > 1)::INT"}
_REPORT = [
    *[f"SELECT 'moments.{n}' AS metric, measure AS key, ({e})::DOUBLE AS value FROM long GROUP BY measure" for n, e in _CELLS.items()],
    "SELECT 'type.count', property_type, count(*) FROM eda GROUP BY 2",
    "SELECT 'type.percent', property_type, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM eda), 2) FROM eda GROUP BY 2",
    f"SELECT 'median_rent_by_type', property_type, median({RENT}) FROM eda GROUP BY 2",
    "SELECT 'bedroom_count', round_even(bedrooms, 0)::INT::VARCHAR, count(*) FROM eda GROUP BY 2",
    f"SELECT 'correlation', x || '|' || y, r FROM ({_MATRIX})",
    f"SELECT 'collinear', x || '|' || y, r FROM ({_MATRIX}) WHERE x < y AND abs(r) > 0.8",
    f"SELECT 'median_rent', property_type || '|' || round_even(bedrooms, 0)::INT, median({RENT}) FROM eda GROUP BY 2",
    *[f"SELECT 'iqr.{n}', NULL, {e} FROM fence" for n, e in {
        "q1": "q1", "q3": "q3", "iqr": "q3 - q1", "lower": "q1 - 1.5 * (q3 - q1)", "upper": "q3 + 1.5 * (q3 - q1)"}.items()],
    "SELECT 'iqr.outliers', NULL, n_iqr FROM flagged", "SELECT 'iqr.percent', NULL, 100.0::DOUBLE * n_iqr / n FROM flagged",
    "SELECT 'zscore.outliers', NULL, n_z FROM flagged", "SELECT 'zscore.percent', NULL, 100.0::DOUBLE * n_z / n FROM flagged",
    *[f"SELECT 'segment.share', '{t}', 100.0::DOUBLE * count(*) FILTER (property_type = '{t}') / count(*) FROM eda" for t in ("Villa", "Twin Villa")],
    f"SELECT 'segment.median', property_type, median({RENT}) FROM eda WHERE property_type IN ('Villa', 'Twin Villa') GROUP BY 2",
    f"SELECT 'anomaly.large_and_dear', NULL, count(*) FROM eda WHERE bedrooms >= 15 AND {RENT} >= 20000",
    f"SELECT 'anomaly.cheap_of_type', NULL, count(*) FROM eda WHERE property_type = 'Flat' AND {RENT} <= 100",
]


@query(WITH_EDA + f""", {LONG},
  fence AS (SELECT quantile_cont({RENT}, 0.25) AS q1, quantile_cont({RENT}, 0.75) AS q3 FROM eda),
  z AS (SELECT avg({RENT}) AS a, stddev_pop({RENT}) AS s FROM eda),
  flagged AS (SELECT count(*) AS n, count(*) FILTER ({RENT} < q1 - 1.5 * (q3 - q1) OR {RENT} > q3 + 1.5 * (q3 - q1)) AS n_iqr,
    count(*) FILTER (abs(({RENT} - a) / s) > 3) AS n_z FROM eda, fence, z)
  SELECT metric, key, round(value, 4) AS value FROM ({' UNION ALL '.join(_REPORT)})""")
def eda_report(spark, sf_dir):
    return B.rounded(plans.eda_report(B.eda(spark, sf_dir)), 4)


_PRICED = "clean WHERE rent_price_usd > 0"


@query(WITH_CLEAN + f"SELECT \"range\", count FROM ({_bands(_PRICED)})")
def dashboard_price_distribution(spark, sf_dir):
    return marts.dashboard(B.clean(spark, sf_dir))["price_distribution"]


@query(WITH_CLEAN + f"""SELECT district AS location, round_even(avg(rent_price_usd), 0) AS avg_price FROM {_PRICED}
  GROUP BY 1 ORDER BY avg_price DESC, location LIMIT 8""")
def dashboard_by_district(spark, sf_dir):
    return marts.dashboard(B.clean(spark, sf_dir))["avg_price_by_district"]


@query(WITH_CLEAN + f"""SELECT bedrooms, round_even(avg(rent_price_usd), 0) AS avg_price FROM {_PRICED} AND bedrooms <= 8 GROUP BY 1""")
def dashboard_by_bedrooms(spark, sf_dir):
    return marts.dashboard(B.clean(spark, sf_dir))["avg_price_by_bedrooms"]


@query(WITH_CLEAN + f"""SELECT property_type AS type, round_even(avg(rent_price_usd), 0) AS avg_price FROM {_PRICED} GROUP BY 1""")
def dashboard_by_type(spark, sf_dir):
    return marts.dashboard(B.clean(spark, sf_dir))["avg_price_by_type"]
