"""Registered queries against their SQL, on the smallest tables, and their plans."""

import compare
import pytest

import __spark_entry__ as entry

CHECKED = """parse_money_class first_number serve_type title_case label_from_document_text fill_attributes scope_filter
dedup_rows impute_median_by_district clean_repeated_listings rejected_requests unify_sources extract_links overview
moments describe correlations histogram density box_stats_by_type pivot_median iqr_fences eda_report feature_columns
shuffled_folds stratified_split context_types context_overall resolve_district_by_containment calibrate room_monotone
feature_impact size_curve respond stream_ingest""".split()


@pytest.fixture(scope="module")
def connection(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, small, connection, name):
    df = entry.queries()[name](spark, small)
    assert compare.differences(df, connection, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and sum(r["count"] for r in rows) > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["clean_type", "quantiles", "iqr_fences", "value_shares", "calibrate", "box_stats_by_type"])
def test_plans_have_no_cartesian_join(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_is_needed(spark, small):
    plan = entry.queries()["median_rent_by_district"](spark, small)._jdf.queryExecution().executedPlan().toString()
    schemas = [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]
    listings = [set(s.split(",")) for s in schemas if "rent_price_usd" in s]  # the others are staged ranks
    assert listings and all(s <= {"district:string", "rent_price_usd:double"} for s in listings)
    assert "IsNotNull(rent_price_usd)" in plan
