"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Tables that later
queries share (clean listings, features, context, located requests) are timed as their own entries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rentlens import catalog
from rentlens.catalog import shared
from rentlens.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

BUILDS = {
    "build_clean": lambda spark: shared.clean(spark, FOLDER),
    "build_features": lambda spark: shared.features(spark, FOLDER),
    "build_context": lambda spark: shared.context(spark, FOLDER).tables["overall"],
    "build_market_requests": lambda spark: shared.market_requests(spark, FOLDER),
}
HEADLINE = """parse_money_class extract_links label_from_document_text dedup_rows price_bands median_rent_by_district
value_shares moments describe quantiles_of_line_items correlations histogram density box_stats_by_type pivot_median
iqr_fences eda_report dashboard_by_district shuffled_folds stratified_split resolve_district_by_containment calibrate
room_monotone score_requests regression_metrics feature_importances stream_ingest""".split()


def main() -> None:
    spark = local_session(CPUS, int(CPUS), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = catalog.queries()
    jobs = BUILDS | {name: (lambda s, q=queries[name]: q(s, FOLDER)) for name in HEADLINE}
    seconds = {}
    for name, job in jobs.items():
        start = time.monotonic()
        job(spark).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
