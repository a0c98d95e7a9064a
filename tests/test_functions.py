"""Hand-written cases of the column expressions."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions import numeric as N
from rentlens.functions import text as T
from rentlens.functions.special import t_two_sided
from rentlens.operators import clean as C
from rentlens.operators.stats import band_of


def values(spark, expr, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.select(expr.alias("y"), "i").sort("i").collect()]


def test_money(spark):
    texts = ["$500/month", "500 per month", "POA", "$1,200", None, "500permonth"]
    assert values(spark, T.parse_money(F.col("x")), texts) == [500, None, None, 1200, None, None]
    assert values(spark, T.parse_money(F.col("x"), "tokens"), texts) == [500, None, None, 1200, None, 500]


def test_first_number(spark):
    texts = ["35m²", "4m x 20m", "1,200 m²", "-5", "12.", "៤ bed", "abc", None, "9" * 400]
    assert values(spark, T.first_number(F.col("x")), texts) == [35, 4, 1, 5, 12, 4, None, None, None]


def test_to_double(spark):
    texts = ["5d", "5f", "nan", "inf", "1_000", "0x10", "", " 5 ", "+5", "5.", "1e3", ".5", "1e999", "\t7\n"]
    assert values(spark, T.to_double(F.col("x")), texts) == [None] * 7 + [5, 5, 5, 1000, 0.5, None, 7]


def test_clamping_keeps_null(spark):
    numbers = [None, 1.0, 50.0, 5000.0]
    assert values(spark, N.clip(F.col("x"), 8, 2000), numbers, "double") == [None, 8, 50, 2000]
    assert values(spark, N.null_outside(F.col("x"), 5, 100), numbers, "double") == [None, None, 50, None]
    assert values(spark, N.finite(F.col("x")), [math.nan, math.inf, -math.inf, 2.0], "double") == [None, None, None, 2]


def test_ratios_and_means(spark):
    half = values(spark, N.round_even(F.col("x")), [0.5, 1.5, 2.5, -0.5], "double")
    assert half == [0, 2, 2, 0]
    assert values(spark, N.safe_ratio(F.lit(3.0), F.col("x"), F.lit(3.0)), [0.0, 2.0, None], "double") == [3, 1.5, 3]
    mean = N.weighted_mean([(0.3, F.col("x")), (0.2, F.lit(10.0)), (0.5, F.lit(None).cast("double"))])
    assert values(spark, mean, [20.0, None], "double") == [16, 10]


def test_types(spark):
    texts = ["Villa", " villa ", "TWIN VILLA", "condo", "link  house", "Townhouse", "Other", None, "castle"]
    assert values(spark, T.clean_type(F.col("x")), texts) == [
        "Villa", "Villa", "Twin Villa", "Condo", "Other", "Other", "Other", "Other", "Other"]
    assert values(spark, T.model_type(F.col("x")), texts) == [
        "Villa", "Villa", "Twin Villa", "Flat", "House", "House", "Unclassified", "Unclassified", "Unclassified"]
    assert values(spark, T.serve_type(F.col("x")), texts) == [
        "Villa", "Villa", "Twin Villa", "Flat", "Link  House", "House", "Other", "Unclassified", "Castle"]


def test_no_break_spaces_are_blank(spark):
    nb = "\u00a0"
    assert values(spark, T.parse_money(F.col("x")), [f"$500{nb}/month", f"{nb}1{nb}200{nb}"]) == [500.0, 1200.0]
    assert values(spark, T.to_double(F.col("x")), [f"{nb}7.5\u3000"]) == [7.5]
    assert values(spark, T.clean_type(F.col("x")), [f"Villa{nb}"]) == ["Villa"]
    assert values(spark, T.model_type(F.col("x")), [f"{nb}twin{nb}villa"]) == ["Twin Villa"]
    assert values(spark, T.normalize_furnished(F.col("x")), [f"{nb}furnished\u2003"]) == ["Furnished"]


def test_title_case_starts_words_after_any_other_character(spark):
    assert values(spark, T.title_case(F.col("x")), ["link-house", "o'neil", "2bed", "A  b", ""]) == [
        "Link-House", "O'Neil", "2Bed", "A  B", ""]


def test_title_case_of_plain_words_and_others(spark):
    texts = ["fully furnished", "  a  bC ", "ÉTÉ chaud", "x\ty", "FLAT", "ab\n", None]
    assert values(spark, T.title_case(F.col("x")), texts) == ["Fully Furnished", "  A  Bc ", "Été Chaud", "X\tY", "Flat", "Ab\n", None]


def test_money_characters_go_without_a_pattern(spark):
    texts = [f"a{b}1{b}{b}2" for b in T.BLANKS] + ["$month/,o", "5\x00", "៥$", "", None]
    want = ["a12"] * len(T.BLANKS) + ["", "5\x00", "៥", "", None]
    assert values(spark, T.money_text(F.col("x")), texts) == want
    rows = spark.createDataFrame([("1",)], "x string").select(T.money_text(F.col("x")))
    assert "regexp" not in rows._jdf.queryExecution().analyzed().toString()


def test_furnished(spark):
    texts = ["fully furnished", "", None, "nan", "None", " Furnished "]
    assert values(spark, T.normalize_furnished(F.col("x")), texts) == [
        "Fully Furnished", "Unknown", "Unknown", "Unknown", "Unknown", "Furnished"]
    described = ["a fully furnished unfurnished flat", "Semi Furnished", "un-furnished", "FULLY FURNISHED", None, "មានសម្ភារៈខ្លះ"]
    assert values(spark, T.furnished_from_text(F.col("x")), described) == [
        "Fully Furnished", "Partly Furnished", "Unfurnished", "Unknown", None, "Partly Furnished"]


def test_places(spark):
    texts = ["Khan Chroy Changvar, Phnom-Penh City", None, "District 9"]
    assert values(spark, T.geo_clean(F.col("x")), texts) == ["chroy changvar phnom penh", "", "9"]
    assert values(spark, T.in_scope(F.col("x"), vocab.SCOPE_TOKEN_GROUPS), texts) == [True, False, False]
    assert values(spark, T.last_token(F.col("x")), ["a, b , c ", "a", ""]) == ["c", "a", ""]


def test_text_attributes(spark):
    texts = ["Villa 3 bedrooms 2 baths 4m x 20m", "បន្ទប់គេង: ៤, bath: 5, 35 m²", "bedrooms: 6", "none"]
    found = {n: values(spark, T.first_match(F.col("x"), p), texts) for n, p in vocab.DESCRIPTION_PATTERNS.items()}
    assert found["bedrooms"] == ["3", "4", "6", None]
    assert found["bathrooms"] == ["2", "5", None, None]
    assert found["size_sqm"] == ["4m x 20m", "35 m²", None, None]
    assert values(spark, T.dimension_product(F.col("x")), ["4 x 20", "4.5X2", "7"]) == [80, 9, None]


def test_attribute_fallbacks(spark):
    rows = spark.createDataFrame(
        [(1, "Villa", "villa 5 bed 3 wc 200 sqm", None, None, None), (2, "Room", "4 x 5", "2", None, None),
         (3, "Castle", None, None, "x", None)],
        "i int, property_type string, title string, bedrooms string, bathrooms string, size_sqm string")
    got = [tuple(r) for r in C.fill_attributes(rows).sort("i").select("bedrooms", "bathrooms", "size_sqm").collect()]
    assert got == [(5, 3, 200), (2, 1, 20), (2, 2, 90)]


def test_bands_are_right_open(spark):
    assert values(spark, band_of(F.col("x")), [0.0, 199.99, 200.0, 999998.0, 999999.0, -1.0], "double") == [0, 0, 1, 9, None, None]


def test_dates(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "not a date"), (3, None)], "i int, x string")
    parts = N.date_parts(F.col("x"))
    got = [tuple(r) for r in rows.sort("i").select(*parts.values()).collect()]
    assert got == [(1, 0, 1), (None, None, None), (None, None, None)]
    assert datetime.date(2024, 1, 1).weekday() == 0


@pytest.mark.parametrize("t, df, p", [(0.0, 5, 1.0), (2.570582, 5, 0.05), (1.959964, 1e7, 0.05), (12.7062, 1, 0.05), (-2.228139, 10, 0.05)])
def test_t_tail(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, abs=2e-6)


def test_requests_are_validated(spark):
    rows = spark.createDataFrame(
        [(1, 60.0, 2.9, 1.0, "Flat"), (2, 0.0, 1.0, 1.0, "Flat"), (3, 60.0, -1.0, 1.0, "Flat"), (4, 60.0, 0.0, 0.0, "Flat"),
         (5, None, 1.0, 1.0, "Flat"), (6, 5.0, 1.0, 1.0, "Flat"), (7, 60.0, 1.0, 1.0, None)],
        "request_id int, size_sqm double, bedrooms double, bathrooms double, property_type string")
    accepted, rejected = C.validate_requests(rows, vocab.FORM_MIN_SIZE)
    assert [tuple(r)[:4] for r in accepted.collect()] == [(1, 60.0, 2, 1)]
    reasons = {r["request_id"]: r["reason"] for r in rejected.collect()}
    assert reasons == {2: "size must be above 0", 3: "bedrooms must not be below 0", 4: "bathrooms must be at least 1",
                       5: "missing number", 6: "size must be at least 6", 7: "missing property type"}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="district"):
        C.require_columns(spark.range(1), ["id", "district"])
