import re

from rentlens.llm import url_filter
from rentlens.llm.catalog import RULES

SHAPE = "page_id long, url string, verdict string, host int"
URLS = [
    None, "", "no scheme", "http://", "http://A.com", "http://a.com/", "http://a.com/x?y=/z", "https://WWW.Example.COM/en/1", "http://example.com/en/", "http://x.example.com/en",
    "http://xexample.com/en/1", "http://b.net/es/1", "http://b.net/fr/", "http://b.net/de/9", "http://m.b.net/de/9/", "http://b.net/de/9.html", "http://c.net/de/9?a#b", "ftp://ÄÖ.net/fr/1",
    "http://b.net#/es/1", "http://b.net?/es/1", "x://y://z.com/a", "http://net/es/2", "http://b.org/1", "http://b.org/1",
]


def expected(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        rule = max(fits, key=lambda r: len(r.name))
        return host, path, rule.name, rule.verdict
    address = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/|\.html?)$", "", path)
    return host, path, None, "block" if host and address in listed else "allow"


def test_verdicts_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], SHAPE)
    listed = {"b.net/de/9", "b.org/1", "a.com/"}
    lists = spark.createDataFrame([(a,) for a in [*listed, None, "b.org/1"]], "address string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES, lists).collect()}
    assert out == {i: expected(u, listed) for i, u in enumerate(URLS)}


def test_repeated_addresses_and_empty_tables(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], SHAPE)
    found = {r.address for r in url_filter.repeated_addresses(pages).collect()}
    assert {"b.net/de/9", "b.org/1"} <= found and "c.net/de/9" not in found
    none = pages.limit(0)
    assert url_filter.judge(none, RULES, url_filter.repeated_addresses(none)).count() == 0
    out = url_filter.judge(pages, [], spark.createDataFrame([], "address string"))
    assert out.count() == len(URLS) and out.where("verdict <> 'allow' or rule is not null").count() == 0


def test_no_python_and_no_cross_join(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "x", 1)], SHAPE)
    plan = url_filter.judge(pages, RULES, url_filter.repeated_addresses(pages))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)
