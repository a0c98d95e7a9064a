"""SQL of the stages that the checks build on, for the checking engine."""

from __future__ import annotations

from rentlens import vocab
from rentlens.sources.shared_tables import LISTINGS_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(expr: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def number(expr: str) -> str:
    pattern = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
    return f"try_cast(nullif(regexp_extract({expr}, '{pattern}', 1), '') AS DOUBLE)"


def money(expr: str, mode: str = "class") -> str:
    pattern = {"class": r"[$,/month\s]", "tokens": r"[$,]|/month|permonth"}[mode]
    return number(f"regexp_replace({expr}, '{pattern}', '', 'g')")


def first_number(expr: str) -> str:
    return rf"try_cast(nullif(regexp_extract({expr}, '(\d+\.?\d*)', 1), '') AS DOUBLE)"


def title(expr: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '([a-z]+|[^a-z]+)'), "
        "lambda s: upper(s[1]) || s[2:]), '')"
    )


def furnished(expr: str) -> str:
    text = title(f"trim({expr})")
    return f"CASE WHEN {expr} IS NULL OR {text} IN ('', 'Nan', 'None') THEN 'Unknown' ELSE {text} END"


def clean_type(expr: str) -> str:
    return case(f"lower(trim({expr}))", vocab.CLEAN_TYPES, q(vocab.CLEAN_TYPE_DEFAULT))


def model_type(expr: str) -> str:
    known = {t.lower(): t for t in vocab.MODEL_TYPES} | vocab.TRAIN_ALIASES
    key = rf"lower(trim(regexp_replace({expr}, '\s+', ' ', 'g')))"
    return case(key, known, q(vocab.MODEL_TYPE_DEFAULT))


def geo(expr: str) -> str:
    inner = f"regexp_replace(lower(coalesce({expr}, '')), 'khan|sangkat|district|city|province|[,-]', ' ', 'g')"
    return rf"trim(regexp_replace({inner}, '\s+', ' ', 'g'))"


def clip(expr: str, lo, hi) -> str:
    return f"CASE WHEN {expr} < {lo} THEN {lo} WHEN {expr} > {hi} THEN {hi} ELSE {expr} END"


ROOMS = "greatest(bedrooms + bathrooms, 1)"

CLEAN = f"""
raw AS ({LISTINGS_SQL}),
parsed AS (
  SELECT DISTINCT listing_id, city, district, location, {clean_type('property_type')} AS property_type,
    {money('rent_price_usd')} AS rent_price_usd,
    CASE WHEN {first_number('size_sqm')} BETWEEN 5 AND 5000 THEN {first_number('size_sqm')} END AS size_sqm,
    CASE WHEN {first_number('bedrooms')} <= 20 THEN {first_number('bedrooms')} END AS bedrooms,
    CASE WHEN {first_number('bathrooms')} <= 20 THEN {first_number('bathrooms')} END AS bathrooms,
    {furnished('furnished')} AS furnished, posted_date, title, source_url
  FROM raw),
usable AS (
  SELECT *, (size_sqm IS NULL)::INT AS size_sqm_was_missing, (bedrooms IS NULL)::INT AS bedrooms_was_missing,
    (bathrooms IS NULL)::INT AS bathrooms_was_missing
  FROM parsed
  WHERE (rent_price_usd BETWEEN 50 AND 50000 OR rent_price_usd IS NULL)
    AND NOT (size_sqm IS NULL AND bedrooms IS NULL AND bathrooms IS NULL)),
medians AS (
  SELECT property_type AS t, median(size_sqm) AS ms, median(bedrooms) AS mb, median(bathrooms) AS mt
  FROM usable GROUP BY property_type),
clean AS (
  SELECT u.* REPLACE (
    coalesce(size_sqm, ms, (SELECT median(size_sqm) FROM usable)) AS size_sqm,
    coalesce(bedrooms, mb, (SELECT median(bedrooms) FROM usable)) AS bedrooms,
    coalesce(bathrooms, mt, (SELECT median(bathrooms) FROM usable)) AS bathrooms)
  FROM usable u JOIN medians ON property_type = t)
"""

EDA = f"""{CLEAN},
eda AS (
  SELECT *, ln(1 + rent_price_usd) AS log_rent, rent_price_usd / size_sqm AS price_per_sqm,
    bathrooms / bedrooms AS room_ratio, bedrooms + bathrooms AS total_rooms
  FROM clean
  WHERE rent_price_usd IS NOT NULL AND size_sqm > 0 AND bedrooms > 0)
"""

TRAINING = f"""{CLEAN},
ranged AS (
  SELECT listing_id, rent_price_usd, size_sqm, bedrooms, bathrooms, size_sqm_was_missing, bedrooms_was_missing,
    bathrooms_was_missing, {model_type('property_type')} AS kind, district, furnished, posted_date
  FROM clean WHERE rent_price_usd BETWEEN 50 AND 500000),
training AS (
  SELECT * FROM (SELECT * REPLACE (
      {clip('size_sqm', 8, 2000)}::DOUBLE AS size_sqm, {clip('bedrooms', 0, 20)}::DOUBLE AS bedrooms,
      {clip('bathrooms', 1, 20)}::DOUBLE AS bathrooms) FROM ranged)
  WHERE size_sqm / {ROOMS} >= 8),
cuts AS (
  SELECT quantile_cont(ln(1 + rent_price_usd), 0.25) AS q1, quantile_cont(ln(1 + rent_price_usd), 0.75) AS q3,
    quantile_cont(rent_price_usd / greatest(size_sqm, 1), 0.01) AS p01,
    quantile_cont(rent_price_usd / greatest(size_sqm, 1), 0.99) AS p99
  FROM training),
kept AS (
  SELECT training.* FROM training, cuts
  WHERE ln(1 + rent_price_usd) BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
    AND rent_price_usd / greatest(size_sqm, 1) BETWEEN p01 AND p99),
shares AS (
  SELECT lower(trim(coalesce(district, 'unknown'))) AS d, count(*) / (SELECT count(*) FROM training) AS district_freq
  FROM training GROUP BY 1)
"""

_FLAGS = ", ".join(
    f"(kind = {q(t)})::INT::DOUBLE AS \"type_{t}\"" for t in vocab.MODEL_TYPES
)
FEATURES = f"""{TRAINING},
features AS (
  SELECT listing_id, rent_price_usd, size_sqm, bedrooms, bathrooms, size_sqm * size_sqm AS size_sqm_sq,
    ln(1 + size_sqm) AS log_size_sqm, CASE WHEN bedrooms > 0 THEN bathrooms / bedrooms ELSE bathrooms END AS bath_per_bed,
    bedrooms + bathrooms AS total_rooms, size_sqm / {ROOMS} AS size_per_room,
    {ROOMS} / greatest(size_sqm, 1) AS room_density, ln(1 + size_sqm / {ROOMS}) AS size_room_balance,
    bedrooms / {ROOMS} AS bedroom_share, bathrooms / {ROOMS} AS bathroom_share,
    sqrt(greatest(size_sqm, 1)) * (0.60 * bedrooms + 0.55 * bathrooms + 1.0) AS room_value_proxy,
    bedrooms * bathrooms AS bed_bath_interaction,
    (lower(trim(furnished)) IN ('furnished', 'fully furnished'))::INT::DOUBLE AS furnished_score,
    district_freq, {_FLAGS},
    size_sqm_was_missing::DOUBLE AS size_sqm_was_missing, bedrooms_was_missing::DOUBLE AS bedrooms_was_missing,
    bathrooms_was_missing::DOUBLE AS bathrooms_was_missing,
    month(posted_date)::DOUBLE AS post_month, (isodow(posted_date) - 1)::DOUBLE AS post_dayofweek,
    quarter(posted_date)::DOUBLE AS post_quarter
  FROM kept JOIN shares ON d = lower(trim(coalesce(district, 'unknown'))))
"""

PPS = "CASE WHEN size_sqm > 5 AND rent > 0.5 * size_sqm AND rent < 300 * size_sqm THEN rent / size_sqm END"
CONTEXT = rf"""{CLEAN},
market_all AS (
  SELECT lower(trim(coalesce(district, ''))) AS district_key, {model_type('property_type')} AS kind,
    rent_price_usd AS rent, size_sqm, bedrooms, bathrooms, month(posted_date) AS post_month,
    isodow(posted_date) - 1 AS post_dayofweek, quarter(posted_date) AS post_quarter
  FROM clean WHERE rent_price_usd > 0 AND NOT regexp_matches(lower(title), '\bsale\b|\bsell\b')),
tails AS (SELECT quantile_cont(rent, 0.01) AS lo, quantile_cont(rent, 0.99) AS hi FROM market_all),
market AS (SELECT market_all.*, {PPS} AS pps FROM market_all, tails WHERE rent BETWEEN lo AND hi),
district_ctx AS (
  SELECT district_key, count(*) AS n, count(*) / (SELECT count(*) FROM market) AS freq, median(rent) AS district_price
  FROM market GROUP BY 1),
type_ctx AS (
  SELECT kind, count(*) AS n, median(rent) AS type_price, median(pps) AS type_pps, median(size_sqm) AS profile_size_sqm,
    median(bedrooms) AS profile_bedrooms, median(bathrooms) AS profile_bathrooms,
    median(size_sqm) / greatest(median(bedrooms) + median(bathrooms), 1) AS profile_size_per_room
  FROM market GROUP BY 1),
bed_prices AS (
  SELECT greatest(least(round_even(bedrooms, 0), 12), 0)::INT AS bucket, median(rent) AS price FROM market GROUP BY 1),
bath_prices AS (
  SELECT greatest(least(round_even(bathrooms, 0), 12), 1)::INT AS bucket, median(rent) AS price FROM market GROUP BY 1),
bed_ctx AS (SELECT *, max(price) OVER (ORDER BY bucket) AS monotone FROM bed_prices),
bath_ctx AS (SELECT *, max(price) OVER (ORDER BY bucket) AS monotone FROM bath_prices),
overall_ctx AS (
  SELECT median(rent) AS overall_price, median(pps) AS overall_pps, median(size_sqm) AS overall_size,
    median(bedrooms) AS overall_bed, median(bathrooms) AS overall_bath, median(post_month)::DOUBLE AS post_month,
    median(post_dayofweek)::DOUBLE AS post_dayofweek, median(post_quarter)::DOUBLE AS post_quarter,
    quantile_cont(pps, 0.1) AS pps_low, quantile_cont(pps, 0.9) AS pps_high,
    (SELECT kind FROM type_ctx ORDER BY n DESC, kind LIMIT 1) AS dominant_type
  FROM market),
contrast_ctx AS (
  SELECT kind AS contrast FROM type_ctx, overall_ctx WHERE kind <> dominant_type
  ORDER BY abs(type_price - (SELECT type_price FROM type_ctx WHERE kind = (SELECT dominant_type FROM overall_ctx))) DESC, kind
  LIMIT 1)
"""

REQUESTS = f"""{CONTEXT},
all_requests AS (
  SELECT listing_id AS request_id, {first_number('size_sqm')} AS size_sqm, {first_number('bedrooms')} AS bedrooms,
    {first_number('bathrooms')} AS bathrooms, property_type, furnished AS furnishing, district, location, city
  FROM raw),
requests AS (
  SELECT * REPLACE (bedrooms::INT AS bedrooms, bathrooms::INT AS bathrooms), {model_type('property_type')} AS kind
  FROM all_requests
  WHERE size_sqm IS NOT NULL AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL AND property_type IS NOT NULL
    AND size_sqm > 0 AND bedrooms >= 0 AND bathrooms >= 1),
located AS (
  SELECT r.*, d.district_key, d.district_price, d.freq
  FROM requests r LEFT JOIN district_ctx d ON {geo('r.district')} = {geo('d.district_key')})
"""


def scored(variants: str, carried: str) -> str:
    """Calibrated price of the rows of ``variants`` (columns ``kind, size_sqm, bedrooms, bathrooms,
    district_price``); ``carried`` names the columns to keep."""
    return f"""
market_rows AS (
  SELECT {carried}, v.kind, v.size_sqm, v.bedrooms, v.bathrooms,
    8 * v.size_sqm + 150 * v.bedrooms + 120 * v.bathrooms AS raw_price, type_pps,
    coalesce(district_price, type_price, overall_price) AS market_price,
    coalesce(profile_size_sqm, overall_size) AS want_size, coalesce(profile_bedrooms, overall_bed) AS want_bed,
    coalesce(profile_bathrooms, overall_bath) AS want_bath,
    CASE WHEN profile_size_per_room > 0 THEN profile_size_per_room
      ELSE greatest(overall_size / greatest(overall_bed + overall_bath, 1), 1) END AS want_per_room,
    coalesce(type_pps, overall_pps) AS base_pps,
    greatest(0.8, least(pps_low, overall_pps * 0.75)) AS lo, pps_high, overall_pps,
    bed_near.monotone AS bed_price, bath_near.monotone AS bath_price
  FROM {variants} v CROSS JOIN overall_ctx LEFT JOIN type_ctx ON type_ctx.kind = v.kind
  LEFT JOIN bed_dense bed_near ON bed_near.target = least(round_even(v.bedrooms, 0), (SELECT max(bucket) FROM bed_ctx))
  LEFT JOIN bath_dense bath_near
    ON bath_near.target = least(greatest(round_even(v.bathrooms, 0), 1), (SELECT max(bucket) FROM bath_ctx))),
parts AS (
  SELECT *, greatest(lo + 2, pps_high, overall_pps * 1.8) AS hi,
    0.30 * market_price + 0.20 * bed_price + 0.20 * bath_price AS anchor_sum,
    greatest(want_bed, 0.5) AS wb, greatest(want_bath, 1) AS wt, greatest(bedrooms + bathrooms, 1) AS rooms
  FROM market_rows),
relations AS (
  SELECT *, CASE WHEN type_pps IS NULL THEN anchor_sum / 0.70
      ELSE anchor_sum + 0.30 * greatest(size_sqm, 1) * type_pps END AS relation_anchor,
    least(greatest(exp(-0.28 * (abs(ln(rooms / greatest(wb + wt, 1))) + abs(ln((bedrooms + 0.5) / (wb + 0.5)))
      + abs(ln((bathrooms + 0.5) / (wt + 0.5)))
      + abs(ln(greatest(greatest(size_sqm, 1) / rooms, 1) / greatest(want_size / greatest(wb + wt, 1), 1))))), 0.35), 1)
      AS coherence,
    base_pps * least(greatest(pow(greatest(size_sqm / rooms, 1) / want_per_room, 0.18), 0.88), 1.16)
      * least(greatest(1 + 0.08 * (bedrooms - want_bed) + 0.05 * (bathrooms - want_bath), 0.82), 1.45) AS expected_pps
  FROM parts),
corridors AS (
  SELECT *, coherence * raw_price + (1 - coherence) * relation_anchor AS blended,
    greatest(lo, expected_pps * 0.72) AS c_lo, least(hi, expected_pps * 1.35) AS c_hi, greatest(size_sqm, 1) AS area
  FROM relations),
steady AS (
  SELECT *, least(greatest(0.6 * greatest(blended / area, 0.01) + 0.4 * expected_pps,
      CASE WHEN c_hi > c_lo THEN c_lo ELSE lo END), CASE WHEN c_hi > c_lo THEN c_hi ELSE hi END) AS pps
  FROM corridors),
scored AS (
  SELECT *, least(greatest(pps * area
      * least(1 + 0.06 * greatest(bedrooms - 1, 0) + 0.04 * greatest(bathrooms - 1, 0), 1.55),
      greatest(50, area * lo)), greatest(greatest(50, area * lo) + 50, area * hi)) AS price
  FROM steady)
"""


DENSE = """
bed_dense AS (
  SELECT t AS target, arg_min(monotone, (abs(bucket - t), bucket)) AS monotone
  FROM bed_ctx, generate_series(0, 12) g(t) GROUP BY t),
bath_dense AS (
  SELECT t AS target, arg_min(monotone, (abs(bucket - t), bucket)) AS monotone
  FROM bath_ctx, generate_series(0, 12) g(t) GROUP BY t)
"""
