"""Queries of features, market context and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.catalog import shared as B
from rentlens.catalog import sql as Q
from rentlens.operators import context as X
from rentlens.operators import features as E
from rentlens.operators import folds as D
from rentlens.operators import live_context as L
from rentlens.operators import scoring as S
from rentlens.operators import sketches as K
from rentlens.operators.lookup import lookup_join
from rentlens.operators.places import resolve_district as resolve
from rentlens.operators.quantiles import quantile_table
from rentlens.session import new_folder
from rentlens.sources.shared_tables import table

QUERIES = {}
ORACLES = {}

WITH_TRAINING = f"WITH {Q.TRAINING} "
WITH_FEATURES = f"WITH {Q.FEATURES} "
WITH_CONTEXT = f"WITH {Q.CONTEXT} "
WITH_REQUESTS = f"WITH {Q.REQUESTS} "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Features and splits


@query(WITH_TRAINING + "SELECT listing_id, rent_price_usd, size_sqm, bedrooms, bathrooms, kind FROM training")
def training_rows(spark, sf_dir):
    rows = E.training_rows(B.clean(spark, sf_dir))
    return rows.select("listing_id", vocab.TARGET, *vocab.STRUCTURAL, "kind")


@query(WITH_TRAINING + "SELECT listing_id FROM kept")
def target_filters(spark, sf_dir):
    return E.target_filters(B.training(spark, sf_dir)).select("listing_id")


@query(WITH_FEATURES + "SELECT listing_id, rent_price_usd, " + ", ".join(
    f'round("{n}", 6) AS "{n}"' for n in vocab.MODEL_FEATURES) + " FROM features")
def feature_columns(spark, sf_dir):
    return B.rounded(E.feature_columns(B.clean(spark, sf_dir)))


@query(WITH_FEATURES + "SELECT listing_id, (ntile(5) OVER (ORDER BY listing_id) - 1)::INT AS fold FROM features")
def contiguous_folds(spark, sf_dir):
    return D.fold_column(B.features(spark, sf_dir), 5).select("listing_id", "fold")


@query(WITH_FEATURES + """, t AS (SELECT 'site/' || listing_id AS listing_id FROM features)
  SELECT listing_id, (ntile(5) OVER (ORDER BY listing_id) - 1)::INT AS fold FROM t""")
def contiguous_folds_text_ids(spark, sf_dir):
    """Ids as pages give them, in text order."""
    rows = B.features(spark, sf_dir).select(F.concat(F.lit("site/"), "listing_id").alias("listing_id"))
    return D.fold_column(rows, 5).select("listing_id", "fold")


@query(WITH_FEATURES + "SELECT listing_id, (ntile(5) OVER (ORDER BY md5(listing_id || '42')) - 1)::INT AS fold FROM features")
def shuffled_folds(spark, sf_dir):
    return D.fold_column(B.features(spark, sf_dir), 5, shuffle=True).select("listing_id", "fold")


_STRATA = WITH_FEATURES + """, edges AS (
  SELECT DISTINCT unnest(quantile_cont(rent_price_usd, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM features),
strata AS (
  SELECT listing_id, rent_price_usd, greatest((SELECT count(*) FROM edges WHERE e < rent_price_usd) - 1, 0)::INT AS stratum
  FROM features) """


@query(_STRATA + "SELECT listing_id, stratum FROM strata")
def label_strata(spark, sf_dir):
    rows = B.features(spark, sf_dir)
    edges = D.strata_edges(rows).scalar()
    return rows.select("listing_id", D.stratum(F.col(vocab.TARGET), edges).alias("stratum"))


@query(_STRATA + """SELECT listing_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(listing_id || '42'))
  <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY stratum)) AS is_test FROM strata""")
def stratified_split(spark, sf_dir):
    return D.stratified_split(B.features(spark, sf_dir)).select("listing_id", "stratum", "is_test")


# Market context


def _points(spark, sf_dir):
    """Quantiles of the context, measured for this query."""
    rows = X.trim_tails(X.market_rows(B.clean(spark, sf_dir)))
    return X.market_points(rows)


@query(WITH_CONTEXT + "SELECT district_key, n, round(freq, 6) AS freq, round(district_price, 6) AS district_price FROM district_ctx")
def context_districts(spark, sf_dir):
    return B.rounded(B.context(spark, sf_dir).tables["district"])


@query(WITH_CONTEXT + """SELECT kind, n, round(type_price, 6) AS type_price, round(type_pps, 6) AS type_pps,
  round(profile_size_sqm, 6) AS profile_size_sqm, round(profile_bedrooms, 6) AS profile_bedrooms,
  round(profile_bathrooms, 6) AS profile_bathrooms, round(profile_size_per_room, 6) AS profile_size_per_room FROM type_ctx""")
def context_types(spark, sf_dir):
    return B.rounded(B.context(spark, sf_dir).tables["type"])


@query(WITH_CONTEXT + "SELECT bucket, round(price, 6) AS price, round(monotone, 6) AS monotone FROM bed_ctx")
def context_bedroom_prices(spark, sf_dir):
    return B.rounded(B.context(spark, sf_dir).tables["bedrooms"])


@query(WITH_CONTEXT + "SELECT bucket, round(price, 6) AS price, round(monotone, 6) AS monotone FROM bath_ctx")
def context_bathroom_prices(spark, sf_dir):
    return B.rounded(B.context(spark, sf_dir).tables["bathrooms"])


_FIGURES = ["overall_price", "overall_pps", "overall_size", "overall_bed", "overall_bath", "post_month", "post_dayofweek",
            "post_quarter", "pps_low", "pps_high"]


@query(WITH_CONTEXT + "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in _FIGURES) + ", dominant_type FROM overall_ctx")
def context_overall(spark, sf_dir):
    """Market-wide figures, measured from the clean table."""
    return B.rounded(X.overall_table(_points(spark, sf_dir)))


def _cells(scope: str, key: str, measures: list[str], condition: str = "true") -> list[str]:
    return [f"SELECT '{scope}' AS scope, {key} AS key, '{m}' AS measure, {m}::DOUBLE AS v FROM priced WHERE {condition}" for m in measures]


_ROOM_KEY = "(greatest(least(round_even({c}, 0), 12), {low})::INT)::VARCHAR"
_LIVE = WITH_CONTEXT + f""", priced AS (SELECT *, {Q.PPS} AS pps FROM market_all), cells AS ({" UNION ALL ".join([
    *_cells("all", "NULL::VARCHAR", ["rent", "pps", *vocab.STRUCTURAL, "post_month", "post_dayofweek", "post_quarter"]),
    *_cells("district", "district_key", ["rent"]), *_cells("type", "kind", ["rent", "pps"]),
    *_cells("type", "kind", list(vocab.STRUCTURAL), "size_sqm IS NOT NULL AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL"),
    *_cells("bedrooms", _ROOM_KEY.format(c="bedrooms", low=0), ["rent"], "bedrooms IS NOT NULL"),
    *_cells("bathrooms", _ROOM_KEY.format(c="bathrooms", low=1), ["rent"], "bathrooms IS NOT NULL")])})
  SELECT scope, key, measure, unnest(CASE WHEN scope = 'all' AND measure = 'pps' THEN [0.1, 0.5, 0.9] ELSE [0.5] END)::DOUBLE AS prob,
    count(*) AS listings, true AS within FROM cells WHERE v IS NOT NULL GROUP BY scope, key, measure"""


@query(_LIVE)
def refreshed_context(spark, sf_dir):
    """Context figures merged from stored sketches of older and newer listings: listings behind each, and
    whether its true rank among the listings between the cuts is within the stated half a percent."""
    listings, path = B.clean(spark, sf_dir), new_folder(spark, "live")
    newer = F.col("posted_date") >= F.lit("1996-01-01")
    L.start(spark, listings.where(~newer), path, "older", accuracy=0.005)
    L.add(spark, listings.where(newer), path, "newer")
    live = L.market(spark, path)
    kept = X.market_rows(listings).where((F.col("rent") >= live.low) & (F.col("rent") < live.high))
    points = live.points.select("scope", "key", "measure", "prob", "quantile")
    groups = ["scope", "key", "measure"]
    judged = K.rank_gaps(L.long_measures(kept), points, groups, "v")
    counts = L.listing_counts(spark, path).withColumnRenamed("n", "listings")
    return lookup_join(judged, counts, groups).select(*groups, "prob", "listings", (F.col("gap") <= 0.005).alias("within"))


@query("SELECT " + ", ".join(
    f"{v}::DOUBLE AS {k}" for k, v in vocab.CONTEXT_DEFAULTS.items() if k != "dominant_type"
) + ", 'House' AS dominant_type FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0")
def context_of_empty_market(spark, sf_dir):
    """No listing is left after the rent filter, so every figure takes its default."""
    none = B.clean(spark, sf_dir).where(F.col(vocab.TARGET) < 0)
    return X.overall_table(X.market_points(X.market_rows(none))).select(*vocab.CONTEXT_DEFAULTS)


@query(WITH_CONTEXT + f"""SELECT {Q.title('district_key')} AS location, round_even(district_price, 2) AS price FROM (
  SELECT * FROM district_ctx ORDER BY district_price DESC, district_key LIMIT 6) WHERE district_key <> ''""")
def top_regions(spark, sf_dir):
    return X.top_regions(B.context(spark, sf_dir).tables["district"])


@query(WITH_CONTEXT + "SELECT contrast AS contrast_type FROM contrast_ctx")
def contrast_type(spark, sf_dir):
    ctx = B.context(spark, sf_dir)
    return X.contrast_type(ctx.tables["type"], ctx.overall["dominant_type"])


@query("""SELECT bucket, price, max(price) OVER (ORDER BY bucket) AS monotone FROM (
  SELECT l_linenumber AS bucket, round(median(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1)""")
def running_max(spark, sf_dir):
    """Monotone prices of the few line numbers."""
    prices = quantile_table(table(spark, sf_dir, "lineitem"), ["l_linenumber"], {"price": ("l_extendedprice", 0.5)})
    prices = prices.select(F.col("l_linenumber").alias("bucket"), F.round("price", 4).alias("price"))
    return X.running_max(prices, "bucket", "price")


# Places


_KEY = Q.geo("d.district_key")
_EXACT = WITH_REQUESTS + f"""SELECT request_id, district_key FROM requests r LEFT JOIN district_ctx d
  ON {Q.geo('r.district')} = {_KEY}"""


@query(_EXACT)
def resolve_district(spark, sf_dir):
    asked = B.requests(spark, sf_dir).select("request_id", "district", "location", "city")
    found = resolve(asked, B.context(spark, sf_dir).tables["district"], cutoff=None)
    return found.select("request_id", "district_key")


@query(WITH_REQUESTS + f""", texts AS (SELECT DISTINCT {Q.geo('location')} AS t FROM requests),
  hits AS (SELECT t, (min((-n, district_key)))[2] AS district_key FROM texts, district_ctx d
    WHERE contains(t, {_KEY}) OR contains({_KEY}, t) GROUP BY t)
  SELECT request_id, coalesce(district_key, '') AS district_key FROM requests LEFT JOIN hits ON {Q.geo('location')} = t""")
def resolve_district_by_containment(spark, sf_dir):
    """The location text holds the district name among other words."""
    asked = B.requests(spark, sf_dir).select("request_id", "location")
    found = resolve(asked, B.context(spark, sf_dir).tables["district"], columns=("location",), cutoff=None)
    return found.select("request_id", "district_key")


@query(WITH_REQUESTS + """SELECT request_id, (SELECT (min((-n, district_key)))[2] FROM district_ctx
  WHERE contains(district_key, 'nation_1') OR contains(district_key, 'nation_2')) AS district_key FROM requests""")
def resolve_district_in_scope(spark, sf_dir):
    """A district in scope takes every request."""
    asked = B.requests(spark, sf_dir).select("request_id", "district")
    found = resolve(asked, B.context(spark, sf_dir).tables["district"], columns=("district",), cutoff=None,
                    scoped_to=[["nation_1", "nation_2"]])
    return found.select("request_id", "district_key")


@query(WITH_REQUESTS + f"""SELECT request_id, replace(r.district, 'ATION', 'ATON') AS district, district_key FROM requests r LEFT JOIN district_ctx d
  ON {Q.geo('r.district')} = {_KEY}""")
def resolve_misspelt_district(spark, sf_dir):
    """A letter is missing from every district name."""
    asked = B.requests(spark, sf_dir).select("request_id", F.replace("district", F.lit("ATION"), F.lit("ATON")).alias("district"))
    found = resolve(asked, B.context(spark, sf_dir).tables["district"], columns=("district",))
    return found.select("request_id", "district", "district_key")


# Scoring


@query(WITH_REQUESTS + f"""SELECT request_id, kind, district_key, round(freq, 6) AS freq, round(district_price, 6) AS district_price
  FROM located""")
def attach_market(spark, sf_dir):
    rows = S.attach_market(B.requests(spark, sf_dir), B.context(spark, sf_dir), cutoff=None)
    return B.rounded(rows.select("request_id", "kind", "district_key", "freq", "district_price"))


@query(WITH_REQUESTS + f""", {Q.DENSE} SELECT request_id, round(b.monotone, 6) AS bedroom_price, round(t.monotone, 6) AS bathroom_price
  FROM requests r
  LEFT JOIN bed_dense b ON b.target = least(r.bedrooms * 2, (SELECT max(bucket) FROM bed_ctx))
  LEFT JOIN bath_dense t ON t.target = least(r.bathrooms * 2, (SELECT max(bucket) FROM bath_ctx))""")
def nearest_bucket(spark, sf_dir):
    """Room prices of twice the rooms asked for, which often lies past the last bucket."""
    ctx = B.context(spark, sf_dir)
    return B.rounded(B.requests(spark, sf_dir).select(
        "request_id",
        X.nearest_bucket(F.col("bedrooms") * 2.0, ctx.buckets["bedrooms"], 0).alias("bedroom_price"),
        X.nearest_bucket(F.col("bathrooms") * 2.0, ctx.buckets["bathrooms"], 1).alias("bathroom_price"),
    ))


_OWN = f"{Q.REQUESTS}, {Q.DENSE}, {Q.scored('located', 'v.request_id')}"
_PARTS = ["market_price", "relation_anchor", "coherence", "expected_pps", "price"]


@query(f"WITH {_OWN} SELECT request_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PARTS) + " FROM scored")
def calibrate(spark, sf_dir):
    """Market price, relation anchor, coherence, expected rent per square metre, calibrated price."""
    rows = S.score(B.market_requests(spark, sf_dir), B.stand_in, B.context(spark, sf_dir))
    return B.rounded(rows.select("request_id", *_PARTS))


_GRID = f"""grid AS (
  SELECT request_id, kind, size_sqm, b AS bedrooms, t AS bathrooms, district_price, pow(1.01, r.bedrooms - b) * pow(1.005, r.bathrooms - t) AS weight,
    b = r.bedrooms AND t = r.bathrooms AS is_base
  FROM located r, LATERAL (SELECT unnest(generate_series(0, r.bedrooms)) AS b),
    LATERAL (SELECT unnest(generate_series(1, r.bathrooms)) AS t))"""
_MONOTONE = f"WITH {Q.REQUESTS}, {Q.DENSE}, {_GRID}, {Q.scored('grid', 'v.request_id, v.weight, v.is_base')}"


@query(_MONOTONE + """, one AS (SELECT request_id, round(max(price) FILTER (is_base), 6) AS price,
  round(max(price * weight), 6) AS monotone_price FROM scored GROUP BY 1) SELECT * FROM one UNION ALL SELECT * FROM one""")
def score_repeated_requests(spark, sf_dir):
    """Every request twice under one id: no row is lost."""
    asked = B.market_requests(spark, sf_dir)
    return B.rounded(S.room_monotone(asked.unionByName(asked), B.stand_in, B.context(spark, sf_dir)))


@query(_MONOTONE + """SELECT request_id, round(max(price) FILTER (is_base), 6) AS price,
  round(max(price * weight), 6) AS monotone_price FROM scored GROUP BY 1""")
def room_monotone(spark, sf_dir):
    return B.rounded(S.room_monotone(B.market_requests(spark, sf_dir), B.stand_in, B.context(spark, sf_dir)))


@query(_MONOTONE + """, p AS (SELECT request_id, max(price * weight) AS price, max(market_price) FILTER (is_base) AS market,
    max(coherence) FILTER (is_base) AS coherence FROM scored GROUP BY 1)
  SELECT request_id, round_even(price, 2) AS predicted_price, round_even(price * 0.90::DOUBLE, 2) AS price_range_low,
    round_even(price * 1.10::DOUBLE, 2) AS price_range_high, 'stand-in' AS model_used,
    'Estimated range ±10%. Relation coherence for this layout: ' || round_even(coherence * 100, 0)::INT || '%.' AS confidence_note,
    round_even(market, 2) AS average_market_price,
    round(abs(CASE WHEN market > 0 THEN (price - market) / market * 100 ELSE 0 END), 1) AS market_diff_pct,
    price > market AS above_market FROM p""")
def respond(spark, sf_dir):
    ctx = B.context(spark, sf_dir)
    rows = S.score_requests(B.market_requests(spark, sf_dir), B.stand_in, ctx, impacts=False, curve=False)
    return S.respond(rows, ctx, "stand-in").drop("regions")


_IMPACT = f"""asked AS (
  SELECT l.*, coalesce(profile_size_sqm, overall_size) AS ws, round_even(coalesce(profile_bedrooms, overall_bed), 0) AS wb,
    greatest(round_even(coalesce(profile_bathrooms, overall_bath), 0), 1) AS wt,
    CASE WHEN l.kind <> dominant_type THEN dominant_type ELSE coalesce((SELECT contrast FROM contrast_ctx), l.kind) END AS wk
  FROM located l CROSS JOIN overall_ctx LEFT JOIN type_ctx ON type_ctx.kind = l.kind),
changed AS (
  SELECT request_id, 1 AS position, 'Property Type' AS label, wk AS kind, size_sqm, bedrooms::DOUBLE AS bedrooms, bathrooms::DOUBLE AS bathrooms, district_price FROM asked
  UNION ALL SELECT request_id, 2, 'Size (sqm)', kind, round_even(CASE WHEN abs(ws - size_sqm) < 2 THEN greatest(6, size_sqm * 0.75::DOUBLE) ELSE ws END, 2),
    bedrooms, bathrooms, district_price FROM asked
  UNION ALL SELECT request_id, 3, 'Bedrooms', kind, size_sqm, CASE WHEN wb <> bedrooms THEN wb WHEN bedrooms < 8 THEN bedrooms + 1 ELSE greatest(0, bedrooms - 1) END,
    bathrooms, district_price FROM asked
  UNION ALL SELECT request_id, 4, 'Bathrooms', kind, size_sqm, bedrooms, CASE WHEN wt <> bathrooms THEN wt WHEN bathrooms < 8 THEN bathrooms + 1
    ELSE greatest(1, bathrooms - 1) END, district_price FROM asked)"""


@query(f"""WITH {Q.REQUESTS}, {Q.DENSE}, {_IMPACT}, {_GRID},
  both_rows AS (SELECT request_id, kind, size_sqm, bedrooms, bathrooms, district_price, weight, 0 AS position, '' AS label FROM grid
    UNION ALL SELECT request_id, kind, size_sqm, bedrooms, bathrooms, district_price, 1, position, label FROM changed),
  {Q.scored('both_rows', 'v.request_id, v.weight, v.position, v.label')},
  base AS (SELECT request_id, max(price * weight) AS base_price FROM scored WHERE position = 0 GROUP BY 1),
  gaps AS (SELECT request_id, label, position, abs(base_price - price) AS gap FROM scored JOIN base USING (request_id) WHERE position > 0),
  totals AS (SELECT request_id, sum(gap) AS total FROM gaps GROUP BY 1)
  SELECT request_id, label AS feature, CASE WHEN total > 0 THEN round(gap / total * 100, 3) ELSE
    CASE label WHEN 'Size (sqm)' THEN 35.0 WHEN 'Property Type' THEN 30.0 WHEN 'Bedrooms' THEN 20.0 ELSE 15.0 END::DOUBLE END AS weight
  FROM gaps JOIN totals USING (request_id)""")
def feature_impact(spark, sf_dir):
    """Share of each single-field change, to three places."""
    ctx = B.context(spark, sf_dir)
    rows = S.score_requests(B.market_requests(spark, sf_dir), B.stand_in, ctx, curve=False, impact_digits=3)
    return rows.select("request_id", F.explode("impacts").alias("i")).select("request_id", "i.feature", "i.weight")


_CURVE = f"""curve AS (
  SELECT request_id, kind, s::DOUBLE AS size_sqm, bedrooms, bathrooms, district_price FROM located,
    (SELECT unnest({vocab.CURVE_SIZES}) AS s))"""


@query(f"""WITH {Q.REQUESTS}, {Q.DENSE}, {_CURVE}, {Q.scored('curve', 'v.request_id')}
  SELECT request_id, size_sqm AS size, round_even(price, 2) AS price FROM scored""")
def size_curve(spark, sf_dir):
    ctx = B.context(spark, sf_dir)
    rows = S.score_variants(B.market_requests(spark, sf_dir), B.stand_in, ctx, S.curve_variants())
    return rows.select("request_id", F.col("size_sqm").alias("size"), F.bround("price", 2).alias("price"))


@query(f"""WITH {Q.REQUESTS}, {Q.DENSE}, {_CURVE}, {Q.scored('curve', 'v.request_id')}
  SELECT request_id, '[' || string_agg('{{"size":' || size_sqm || ',"price":' || round_even(price, 2) || '}}', ',' ORDER BY size_sqm) || ']' AS size_curve
  FROM scored GROUP BY request_id""")
def curve_records(spark, sf_dir):
    """The price curve of each request as JSON records."""
    ctx = B.context(spark, sf_dir)
    rows = S.score_requests(B.market_requests(spark, sf_dir), B.stand_in, ctx, impacts=False)
    return S.to_records(S.respond(rows, ctx, "stand-in"), "size_curve").select("request_id", "size_curve")


@query(WITH_REQUESTS + f"""SELECT request_id, place, top.location, top.price FROM requests, (
  SELECT row_number() OVER (ORDER BY p DESC, location) - 1 AS place, location, price FROM (
    SELECT {Q.title('district_key')} AS location, round_even(district_price, 2) AS price, district_price AS p
    FROM (SELECT * FROM district_ctx ORDER BY district_price DESC, district_key LIMIT 6) WHERE district_key <> '') LIMIT 4) AS top""")
def response_regions(spark, sf_dir):
    """The four dearest regions in each response."""
    ctx = B.context(spark, sf_dir)
    rows = S.respond(S.score_requests(B.market_requests(spark, sf_dir), B.stand_in, ctx, impacts=False, curve=False), ctx, "stand-in")
    return rows.select("request_id", F.posexplode("regions").alias("place", "r")).select("request_id", F.col("place").cast("long").alias("place"), "r.location", "r.price")


@query()
def score_requests(spark, sf_dir):
    """Full response: price, band, note, impacts, curve and regions, records as JSON."""
    ctx = B.context(spark, sf_dir)
    rows = S.respond(S.score_requests(B.market_requests(spark, sf_dir), B.stand_in, ctx), ctx, "stand-in")
    for column in ("impacts", "size_curve", "regions"):
        rows = S.to_records(rows, column)
    return rows


@query(WITH_REQUESTS + f"""SELECT request_id, size_sqm, bedrooms::DOUBLE AS bedrooms, bathrooms::DOUBLE AS bathrooms,
  round(sqrt(greatest(size_sqm, 1)) * (0.60 * bedrooms + 0.55 * bathrooms + 1.0), 6) AS room_value_proxy,
  (CASE WHEN lower(trim(furnishing)) IN ('furnished', 'fully furnished') THEN 1 ELSE 0 END)::DOUBLE AS furnished_score,
  round(freq, 6) AS district_freq, (kind = 'Villa')::INT::DOUBLE AS "type_Villa", 0.0::DOUBLE AS size_sqm_was_missing,
  post_month, post_dayofweek, post_quarter FROM located, overall_ctx""")
def serve_features(spark, sf_dir):
    rows = S.serve_features(B.market_requests(spark, sf_dir), B.context(spark, sf_dir))
    names = ["size_sqm", "bedrooms", "bathrooms", "room_value_proxy", "furnished_score", "district_freq", "type_Villa",
             "size_sqm_was_missing", "post_month", "post_dayofweek", "post_quarter"]
    return B.rounded(rows.select("request_id", *names))


@query(WITH_REQUESTS + f"""SELECT request_id, wk AS reference_type FROM (SELECT request_id,
  CASE WHEN kind <> dominant_type THEN dominant_type ELSE coalesce((SELECT contrast FROM contrast_ctx), kind) END AS wk
  FROM located, overall_ctx)""")
def reference_type(spark, sf_dir):
    ctx = B.context(spark, sf_dir)
    return B.market_requests(spark, sf_dir).select("request_id", S.reference_type(ctx).alias("reference_type"))
