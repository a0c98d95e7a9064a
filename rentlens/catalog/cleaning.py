"""Queries of sources, parsing and cleaning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.catalog import shared as B
from rentlens.catalog import sql as Q
from rentlens.functions import numeric as N
from rentlens.functions import text as T
from rentlens.operators import clean as C
from rentlens.plans import cleaning as plans
from rentlens.session import new_folder, stage
from rentlens.sources import pages as P
from rentlens.sources.csv_files import read_listings_csv as read_csv
from rentlens.sources.shared_tables import LISTINGS_SQL, listings_raw, listings_repeated, table
from rentlens.sources.tables import save_table

QUERIES = {}
ORACLES = {}

RAW = f"WITH raw AS ({LISTINGS_SQL}) "
ID = "listing_id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def projection(name: str, expr, sql: str, cast: str = "double") -> None:
    """A query that computes one value per raw listing."""
    QUERIES[name] = lambda spark, sf_dir: B.rounded(
        listings_raw(spark, sf_dir).select(ID, expr().cast(cast).alias("value"))
    )
    value = f"round(({sql})::DOUBLE, 6)" if cast == "double" else sql
    ORACLES[name] = RAW + f"SELECT listing_id, {value} AS value FROM raw"



projection("parse_money_class", lambda: T.parse_money(F.col("rent_price_usd"), "class"), Q.money("rent_price_usd"))
projection("parse_money_tokens", lambda: T.parse_money(F.col("rent_price_usd"), "tokens"), Q.money("rent_price_usd", "tokens"))
projection("first_number", lambda: T.first_number(F.col("size_sqm")), Q.first_number("size_sqm"))
projection("to_double", lambda: T.to_double(F.col("rent_price_usd")), Q.number("rent_price_usd"))
projection(
    "null_outside", lambda: N.null_outside(T.first_number(F.col("size_sqm")), 50, 400),
    f"CASE WHEN {Q.first_number('size_sqm')} BETWEEN 50 AND 400 THEN {Q.first_number('size_sqm')} END",
)
projection(
    "clip", lambda: N.clip(T.first_number(F.col("size_sqm")), 50, 400), Q.clip(Q.first_number("size_sqm"), 50, 400)
)
projection(
    "finite", lambda: N.finite(F.exp(T.first_number(F.col("size_sqm")) * 3)) * 0 + 1,
    f"CASE WHEN {Q.first_number('size_sqm')} * 3 < 709.78 THEN 1 END",
)
projection("clean_type", lambda: T.clean_type(F.col("property_type")), Q.clean_type("property_type"), "string")
projection("model_type", lambda: T.model_type(F.col("property_type")), Q.model_type("property_type"), "string")
_SERVED = RAW + (
    ", served AS (SELECT listing_id, concat(property_type, CASE WHEN city = 'ASIA' THEN '-two' ELSE '' END) AS kind FROM raw) "
)


@query(_SERVED + "SELECT listing_id, " + Q.case(
    "lower(trim(coalesce(nullif(kind, ''), 'Unclassified')))", vocab.SERVE_ALIASES, Q.title("trim(kind)")
) + " AS value FROM served")
def serve_type(spark, sf_dir):
    """Some types are unknown to the aliases and stay, in title case."""
    kind = F.concat(F.coalesce(F.col("property_type"), F.lit("")), F.when(F.col("city") == "ASIA", "-two").otherwise(""))
    return listings_raw(spark, sf_dir).select(ID, T.serve_type(kind).alias("value"))


projection("normalize_furnished", lambda: T.normalize_furnished(F.col("furnished")), Q.furnished("furnished"), "string")
projection("title_case", lambda: T.title_case(F.col("location")), Q.title("location"), "string")
projection("geo_clean", lambda: T.geo_clean(F.col("location")), Q.geo("location"), "string")
projection(
    "last_token", lambda: T.last_token(F.col("location")), "trim(string_split(location, ',')[-1])", "string"
)
projection(
    "safe_ratio", lambda: N.safe_ratio(T.first_number(F.col("bathrooms")), T.first_number(F.col("bedrooms")), T.first_number(F.col("bathrooms"))),
    f"CASE WHEN {Q.first_number('bedrooms')} > 0 THEN {Q.first_number('bathrooms')} / {Q.first_number('bedrooms')} "
    f"ELSE {Q.first_number('bathrooms')} END",
)
projection(
    "round_even", lambda: N.round_even(T.first_number(F.col("size_sqm")) / 2),
    f"round_even({Q.first_number('size_sqm')} / 2, 0)",
)
projection(
    "weighted_mean",
    lambda: N.weighted_mean([(0.5, T.first_number(F.col("size_sqm"))), (0.3, T.first_number(F.col("bedrooms"))), (0.2, T.first_number(F.col("bathrooms")))]),
    f"(coalesce(0.5 * {Q.first_number('size_sqm')}, 0) + coalesce(0.3 * {Q.first_number('bedrooms')}, 0) "
    f"+ coalesce(0.2 * {Q.first_number('bathrooms')}, 0)) / nullif("
    f"CASE WHEN {Q.first_number('size_sqm')} IS NULL THEN 0 ELSE 0.5 END + "
    f"CASE WHEN {Q.first_number('bedrooms')} IS NULL THEN 0 ELSE 0.3 END + "
    f"CASE WHEN {Q.first_number('bathrooms')} IS NULL THEN 0 ELSE 0.2 END, 0)",
)

@query(RAW + """SELECT listing_id, CASE WHEN d LIKE '%fully furnished%' THEN 'Fully Furnished'
  WHEN d LIKE '%unfurnished%' THEN 'Unfurnished' ELSE 'Unknown' END AS value
  FROM (SELECT listing_id, concat_ws(' ', title, furnished) AS d FROM raw)""")
def furnished_from_text(spark, sf_dir):
    text = F.concat_ws(" ", "title", "furnished")
    return listings_raw(spark, sf_dir).select(ID, T.furnished_from_text(text).alias("value"))


@query(RAW + """SELECT listing_id, month(posted_date)::DOUBLE AS post_month,
  (isodow(posted_date) - 1)::DOUBLE AS post_dayofweek, quarter(posted_date)::DOUBLE AS post_quarter FROM raw""")
def date_parts(spark, sf_dir):
    parts = N.date_parts(F.col("posted_date"))
    return listings_raw(spark, sf_dir).select(ID, *[c.alias(n) for n, c in parts.items()])


_LABELS = [("French", [" les ", " des "]), ("German", [" der ", " und "]), ("English", [" the ", " of "])]


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN NULL
  WHEN contains(text, ' les ') OR contains(text, ' des ') THEN 'French'
  WHEN contains(text, ' der ') OR contains(text, ' und ') THEN 'German'
  WHEN contains(text, ' the ') OR contains(text, ' of ') THEN 'English' ELSE 'Unknown' END AS label FROM documents""")
def label_from_document_text(spark, sf_dir):
    """Keyword labels over whole documents, with another keyword table."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", T.furnished_from_text(F.col("text"), _LABELS).alias("label"))


_DOC_PATTERNS = {"number": [r"(\d+\.\d+)", r"(\d+)"], "address": [r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)"]}


@query(r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\d+\.\d+)', 1), ''),
    nullif(regexp_extract(text, '(\d+)', 1), '')) AS number_text,
  nullif(regexp_extract(text, '([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)', 1), '') AS address_text FROM documents""")
def attributes_from_document_text(spark, sf_dir):
    """Ordered patterns over whole documents."""
    found = C.attributes_from_text(table(spark, sf_dir, "documents"), "text", _DOC_PATTERNS)
    return found.select("doc_id", "number_text", "address_text")


def _described(spark, sf_dir):
    text = F.concat_ws(", ", "title", "bedrooms", F.concat("bathrooms", F.lit(" bathrooms")), "size_sqm")
    return listings_raw(spark, sf_dir).withColumn("description", text)


_DESCRIBED = RAW + (
    ", described AS (SELECT *, concat_ws(', ', title, bedrooms, bathrooms || ' bathrooms', size_sqm) AS description FROM raw) "
)


def _first_of(expr: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({expr}, '{p}', 1), '')" for p in patterns) + ")"


@query(_DESCRIBED + "SELECT listing_id, " + ", ".join(
    f"{_first_of('description', p)} AS {n}_text" for n, p in vocab.DESCRIPTION_PATTERNS.items()) + " FROM described")
def attributes_from_text(spark, sf_dir):
    found = C.attributes_from_text(_described(spark, sf_dir), "description", vocab.DESCRIPTION_PATTERNS)
    return found.select("listing_id", *[f"{n}_text" for n in vocab.DESCRIPTION_PATTERNS])


def _default(i: int) -> str:
    whens = " ".join(f"WHEN {Q.q(t)} THEN {v[i]}" for t, v in vocab.TYPE_DEFAULTS.items())
    return f"CASE coalesce(trim(property_type), 'Other') {whens} ELSE {vocab.OTHER_TYPE_DEFAULTS[i]} END"


def _titled(name: str, i: int, middle: str = "") -> str:
    text = Q.number(_first_of("description", vocab.TITLE_PATTERNS[name]))
    return f"coalesce({text}, {middle}{_default(i)}::DOUBLE)"


_DIMS = "".join(
    f"{'' if g == 1 else ' * '}try_cast(nullif(regexp_extract(description, '{vocab.DIMENSIONS_PATTERN}', {g}), '') AS DOUBLE)"
    for g in (1, 2)
)


@query(_DESCRIBED + f"""SELECT listing_id, city, district, location, coalesce(trim(property_type), 'Other') AS property_type,
  {Q.money('rent_price_usd', 'tokens')} AS rent_price_usd,
  {Q.clip(_titled('size_sqm', 2, _DIMS + ', '), 8, 2000)}::DOUBLE AS size_sqm,
  {Q.clip(_titled('bedrooms', 0), 0, 20)}::DOUBLE AS bedrooms,
  {Q.clip(_titled('bathrooms', 1), 1, 20)}::DOUBLE AS bathrooms
  FROM described WHERE {Q.money('rent_price_usd', 'tokens')} IS NOT NULL""")
def fill_attributes(spark, sf_dir):
    """Fallback cleaning of listings that carry their attributes only in the title."""
    listings = _described(spark, sf_dir).drop("title", *vocab.STRUCTURAL).withColumnRenamed("description", "title")
    return plans.auto_clean(listings)


@query(RAW + f"""SELECT listing_id, {Q.money('rent_price_usd')} AS rent_price_usd FROM raw
  WHERE {Q.money('rent_price_usd')} BETWEEN 50 AND 5000 OR {Q.money('rent_price_usd')} IS NULL""")
def filter_range_keep_null(spark, sf_dir):
    rents = listings_raw(spark, sf_dir).select("listing_id", T.parse_money(F.col("rent_price_usd")).alias("rent_price_usd"))
    return C.filter_range(rents, "rent_price_usd", 50, 5000, keep_null=True)


@query(RAW + f"""SELECT listing_id, {Q.money('rent_price_usd')} AS rent_price_usd FROM raw
  WHERE {Q.money('rent_price_usd')} BETWEEN 50 AND 5000""")
def filter_range(spark, sf_dir):
    rents = listings_raw(spark, sf_dir).select("listing_id", T.parse_money(F.col("rent_price_usd")).alias("rent_price_usd"))
    return C.filter_range(rents, "rent_price_usd", 50, 5000)


@query(RAW + "SELECT listing_id, size_sqm, bedrooms, bathrooms FROM raw "
       "WHERE size_sqm IS NOT NULL OR bedrooms IS NOT NULL OR bathrooms IS NOT NULL")
def drop_all_missing(spark, sf_dir):
    return C.drop_missing(listings_raw(spark, sf_dir).select("listing_id", *vocab.STRUCTURAL), vocab.STRUCTURAL, "all")


@query(RAW + "SELECT listing_id, size_sqm, bedrooms, bathrooms FROM raw "
       "WHERE size_sqm IS NOT NULL AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL")
def drop_any_missing(spark, sf_dir):
    return C.drop_missing(listings_raw(spark, sf_dir).select("listing_id", *vocab.STRUCTURAL), vocab.STRUCTURAL)


@query(RAW + "SELECT listing_id, city, district, location, property_type, rent_price_usd, size_sqm, bedrooms, bathrooms FROM raw")
def drop_columns(spark, sf_dir):
    return C.drop_columns(listings_raw(spark, sf_dir), [*vocab.ADMIN_COLUMNS, "log_rent"])


@query(RAW + "SELECT listing_id, NULL::VARCHAR AS agent, 'unknown' AS state, property_type FROM raw")
def with_defaults(spark, sf_dir):
    listings = listings_raw(spark, sf_dir).select("listing_id", "property_type")
    return C.with_defaults(
        listings, {"agent": F.lit(None).cast("string"), "state": F.lit("unknown"), "property_type": F.lit("never")}
    )


@query(RAW + "SELECT listing_id, (size_sqm IS NULL)::INT AS size_sqm_was_missing, "
       "(bedrooms IS NULL)::INT AS bedrooms_was_missing, (bathrooms IS NULL)::INT AS bathrooms_was_missing FROM raw")
def missing_flags(spark, sf_dir):
    flagged = C.missing_flags(listings_raw(spark, sf_dir), vocab.STRUCTURAL)
    return flagged.select("listing_id", *[f"{c}_was_missing" for c in vocab.STRUCTURAL])


@query(f"WITH {Q.CLEAN} SELECT listing_id FROM clean WHERE size_sqm / {Q.ROOMS} >= 30")
def plausible_layout(spark, sf_dir):
    return C.plausible_layout(B.clean(spark, sf_dir), 30.0).select("listing_id")


@query(RAW + "SELECT listing_id, district FROM raw WHERE contains(lower(district), 'nation') "
       "AND (contains(lower(district), '_1') OR contains(lower(district), '_2'))")
def scope_filter(spark, sf_dir):
    listings = listings_raw(spark, sf_dir).select("listing_id", "district")
    return C.scope_filter(listings, "district", [["nation"], ["_1", "_2"]])


@query(RAW + "SELECT listing_id, district FROM raw")
def scope_filter_without_match(spark, sf_dir):
    """No place is in scope, so every row stays."""
    return C.scope_filter(listings_raw(spark, sf_dir).select("listing_id", "district"), "district")


@query(RAW + "SELECT listing_id, title FROM raw WHERE title IS NULL OR NOT regexp_matches(lower(title), '\\bsale\\b|\\bsell\\b')")
def drop_sale_like(spark, sf_dir):
    return C.drop_sale_like(listings_raw(spark, sf_dir).select("listing_id", "title"))


_DUP = RAW + ", repeated AS (SELECT raw.* FROM raw JOIN lineitem ON listing_id = l_orderkey) "


@query(_DUP + "SELECT DISTINCT * FROM repeated")
def dedup_rows(spark, sf_dir):
    return C.dedup(listings_repeated(spark, sf_dir))


@query("""SELECT l_suppkey, l_returnflag, (min((l_orderkey, l_linenumber)))[1] AS l_orderkey,
  (min((l_orderkey, l_linenumber)))[2] AS l_linenumber FROM lineitem GROUP BY 1, 2""")
def dedup_by_key(spark, sf_dir):
    """One line item per supplier and flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return C.dedup(lines, ["l_suppkey", "l_returnflag"])


@query(f"""WITH {Q.CLEAN} SELECT listing_id, round(size_sqm, 6) AS size_sqm, round(bedrooms, 6) AS bedrooms,
  round(bathrooms, 6) AS bathrooms FROM clean""")
def impute_median(spark, sf_dir):
    usable = plans.usable_listings(listings_raw(spark, sf_dir))
    usable = usable.select("listing_id", "property_type", *vocab.STRUCTURAL)
    filled = C.impute_median(usable, vocab.STRUCTURAL, by="property_type", closed=True)
    return B.rounded(filled.select("listing_id", *vocab.STRUCTURAL))


@query(f"""WITH {Q.CLEAN}, m AS (SELECT district AS d, median(size_sqm) AS size_med FROM usable GROUP BY 1)
  SELECT listing_id, round(coalesce(size_sqm, size_med, (SELECT median(size_sqm) FROM usable)), 6) AS size_sqm
  FROM usable JOIN m ON d = district""")
def impute_median_by_district(spark, sf_dir):
    """Imputation by an open key: the table of medians is measured before it is broadcast."""
    usable = plans.usable_listings(listings_raw(spark, sf_dir)).select("listing_id", "district", "size_sqm")
    return B.rounded(C.impute_median(usable, ["size_sqm"], by="district").select("listing_id", "size_sqm"))


@query(f"""WITH {Q.CLEAN} SELECT listing_id, round(coalesce(size_sqm, (SELECT median(size_sqm) FROM usable)), 6) AS size_sqm
  FROM usable""")
def impute_overall_median(spark, sf_dir):
    usable = plans.usable_listings(listings_raw(spark, sf_dir)).select("listing_id", "size_sqm")
    return B.rounded(C.impute_median(usable, ["size_sqm"], by=None))


@query(f"WITH {Q.CLEAN} SELECT * FROM clean")
def clean_listings(spark, sf_dir):
    return plans.clean_listings(listings_raw(spark, sf_dir))


@query(f"""WITH {Q.CLEAN} SELECT listing_id, city, district, location, property_type, rent_price_usd, size_sqm, bedrooms,
  bathrooms FROM clean""")
def clean_repeated_listings(spark, sf_dir):
    """Cleaning of a table full of copies gives the same published table."""
    listings = listings_repeated(spark, sf_dir).unionByName(listings_raw(spark, sf_dir))
    return plans.clean_listings(listings, parity=True)


_REASON = """CASE WHEN size_sqm IS NULL OR bedrooms IS NULL OR bathrooms IS NULL THEN 'missing number'
  WHEN property_type IS NULL THEN 'missing property type' WHEN size_sqm < 100 THEN 'size must be at least 100' END"""


@query(f"""WITH {Q.REQUESTS} SELECT request_id, size_sqm, bedrooms::INT AS bedrooms, bathrooms::INT AS bathrooms
  FROM all_requests WHERE {_REASON} IS NULL""")
def validate_requests(spark, sf_dir):
    accepted, _ = C.validate_requests(B.all_requests(spark, sf_dir), form_min_size=100.0)
    return accepted.select("request_id", *vocab.STRUCTURAL)


@query(f"""WITH {Q.REQUESTS} SELECT request_id, CASE WHEN property_type IS NULL THEN 'missing property type' WHEN request_id % 3 = 0 THEN 'size is not finite'
    WHEN request_id % 3 = 1 THEN 'too many rooms' ELSE {_REASON} END AS reason
  FROM all_requests WHERE size_sqm IS NOT NULL AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL AND (request_id % 3 < 2 OR {_REASON} IS NOT NULL)""")
def rejected_huge_requests(spark, sf_dir):
    """Infinite sizes and room counts past every whole number type."""
    kind = F.pmod("request_id", F.lit(3))
    rows = B.all_requests(spark, sf_dir).where("size_sqm is not null and bedrooms is not null and bathrooms is not null").withColumns({
        "size_sqm": F.when(kind == 0, F.lit(float("inf"))).otherwise(F.col("size_sqm")),
        "bedrooms": F.when(kind == 1, F.lit(99999999999.0)).otherwise(F.col("bedrooms")),
    })
    return C.validate_requests(rows, form_min_size=100.0)[1].select("request_id", "reason")


@query(f"WITH {Q.REQUESTS} SELECT request_id, {_REASON} AS reason FROM all_requests WHERE {_REASON} IS NOT NULL")
def rejected_requests(spark, sf_dir):
    _, rejected = C.validate_requests(B.all_requests(spark, sf_dir), form_min_size=100.0)
    return rejected.select("request_id", "reason")


@query(RAW + "SELECT listing_id AS id, rent_price_usd, district, property_type FROM raw")
def map_columns(spark, sf_dir):
    logical = listings_raw(spark, sf_dir).select(
        F.col("listing_id").alias("id"), F.col("rent_price_usd").alias("price"), F.col("district").alias("location"), F.col("property_type").alias("type")
    )
    return P.map_columns(logical)


@query(RAW + """SELECT regexp_extract(source_url, 'adid-(\\d+)$', 1) AS listing_id, rent_price_usd, district,
    location AS address, NULL AS land_area, source_url FROM raw
  UNION ALL SELECT md5(replace(source_url, 'adid-', 'item/')) AS listing_id, rent_price_usd, district, NULL AS address,
    size_sqm AS land_area, replace(source_url, 'adid-', 'item/') AS source_url FROM raw""")
def unify_sources(spark, sf_dir):
    """Two sources with different columns and address forms."""
    raw = listings_raw(spark, sf_dir)
    first = raw.select(F.col("rent_price_usd").alias("price"), F.col("district").alias("location"), F.col("location").alias("address"), "source_url")
    second = raw.select(F.col("rent_price_usd").alias("price"), F.col("district").alias("location"), F.col("size_sqm").alias("land_area"),
                        F.replace("source_url", F.lit("adid-"), F.lit("item/")).alias("source_url"))
    return P.unify_sources([first, second])


def _decoded(text: str) -> str:
    """SQL of a text with the references the pages use decoded, ``&amp;`` last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "\'\'"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


_HREF = "split_part(part, '\"', 1)"


@query(f"""SELECT DISTINCT page_id, CASE WHEN starts_with(h, '/') THEN 'https://example.com' || h ELSE h END AS link
  FROM (SELECT page_id, {_decoded(_HREF)} AS h
    FROM (SELECT page_id, unnest(string_split(html, '<a href="')[2:]) AS part FROM pages))
  WHERE starts_with(h, '/') OR starts_with(h, 'http')""")
def extract_links(spark, sf_dir):
    return P.extract_links(table(spark, sf_dir, "pages"), "https://example.com")


_TITLE = "split_part(split_part(html, '<title>', 2), '</title>', 1)"


@query(f"SELECT page_id, nullif(trim({_decoded(_TITLE)}), '') AS title FROM pages")
def page_titles(spark, sf_dir):
    return P.page_titles(table(spark, sf_dir, "pages"))


_FILE = ["listing_id", "district", "location", "property_type", "rent_price_usd", "size_sqm", "bedrooms", "title"]


@query(RAW + "SELECT listing_id::VARCHAR AS listing_id, " + ", ".join(_FILE[1:]) + ", NULL::VARCHAR AS agent FROM raw")
def read_listings_csv(spark, sf_dir):
    """Raw listings written as CSV files and read back as text, from the first path that exists."""
    path = new_folder(spark, "csv")
    save_table(listings_raw(spark, sf_dir).select(*_FILE), path, "csv")
    return read_csv(spark, [f"{path}-missing", path], ["district", "agent"])


def _under_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one file, header first."""
    yield pa.RecordBatch.from_pydict({"value": ["listing_id,note,size_sqm"]})
    yield from batches


@query(RAW + """SELECT listing_id::VARCHAR AS listing_id, property_type || chr(10) || 'in "' || location || '"' AS note, size_sqm FROM raw
  WHERE listing_id % 7 <> 0 AND property_type IS NOT NULL""")
def read_malformed_csv(spark, sf_dir):
    """Files of quoted line breaks, doubled quotes, short rows and rows with too many values, in small byte ranges."""
    raw = listings_raw(spark, sf_dir).where("property_type is not null")
    note = F.concat("property_type", F.lit('\nin ""'), "location", F.lit('""'))
    line = F.concat(F.col("listing_id").cast("string"), F.lit(',"'), note, F.lit('"'))
    line = F.when(F.col("listing_id") % 7 == 0, F.concat(line, F.lit(",1,2,3"))).when(F.col("size_sqm").isNull(), line).otherwise(F.concat(line, F.lit(","), "size_sqm"))
    path, ranges = new_folder(spark, "broken"), "spark.sql.files.maxPartitionBytes"
    blank = spark.createDataFrame([("",)], "value string")  # keeps a file where there are no listings; empty records are left out
    raw.select(line.alias("value")).unionByName(blank).mapInArrow(_under_header, "value string").write.text(path)
    before = spark.conf.get(ranges)
    spark.conf.set(ranges, "64k")
    try:
        return stage(read_csv(spark, path), "broken-rows")
    finally:
        spark.conf.set(ranges, before)


@query(RAW + """SELECT c AS "column", c IN ('listing_id', 'rent_price_usd', 'size_sqm') AS present, CASE WHEN c <> 'floor' THEN count(*) END AS rows
  FROM raw, (SELECT unnest(['listing_id', 'rent_price_usd', 'size_sqm', 'floor']) AS c) GROUP BY c""")
def required_columns(spark, sf_dir):
    """Which required columns the listings have, and the rows that can be read by them."""
    return C.column_presence(listings_raw(spark, sf_dir), ["listing_id", "rent_price_usd", "size_sqm", "floor"])


_PAGE_RULES = {
    "title": {"tag": "h1"},
    "description": {"tag": "article"},
    "address": {"tag": "a", "inside": "", "index": 1},
    "location": {"classes": "ad"},
}


_BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH parts AS (
  SELECT page_id, url, split_part(split_part(html, '<h1>', 2), '</h1>', 1) AS h1, split_part(split_part(html, '<article>', 2), '</article>', 1) AS article,
    split_part(split_part(html, '<div class="ad">', 2), '</div>', 1) AS ad, split_part(split_part(string_split(html, '<a href="')[3], '>', 2), '<', 1) AS second FROM pages
), pieces AS (
  SELECT page_id, url, string_agg(piece, ' ' ORDER BY i) AS description FROM (
    SELECT page_id, url, i, {_BARE.format(_decoded('x'))} AS piece
    FROM (SELECT page_id, url, unnest(string_split_regex(article, '<[^>]*>')) AS x, generate_subscripts(string_split_regex(article, '<[^>]*>'), 1) AS i FROM parts))
  WHERE piece <> '' GROUP BY 1, 2
) SELECT page_id, url, {_BARE.format(_decoded('h1'))} AS title, NULL::VARCHAR AS price, {_BARE.format(_decoded('ad'))} AS location,
  {_BARE.format(_decoded('second'))} AS address, description, """ + ", ".join(f"NULL::VARCHAR AS {c}" for c in P.LABELLED) + """
  FROM parts LEFT JOIN pieces USING (page_id, url)""")
def extract_fields(spark, sf_dir):
    """Fields of whole pages by a layout: heading, article text, second link, notice."""
    return P.extract_fields(table(spark, sf_dir, "pages"), _PAGE_RULES)


@query()
def listings_from_pages(spark, sf_dir):
    """Raw listing rows of whole pages, with ids."""
    fields = P.extract_fields(table(spark, sf_dir, "pages"), _PAGE_RULES)
    return P.unify_sources([P.listing_rows(fields)])
