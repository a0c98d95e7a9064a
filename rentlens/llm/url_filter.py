"""URL filter: host and path rules, then a Bloom filter of listed pages before an exact join.

Hosts and paths are split by position as the contract of the query states them. A listed page is known by
its canonical address: host without a leading ``www.`` or ``m.``, path without a last ``/`` or ``.html``;
scheme, query and fragment do not count. The blocked Bloom filter passes possible hits, and only those go
to the exact hash join, so an address is blocked only if it is listed.

Null or malformed addresses have empty host and path; no rule fits them and no list holds them: allowed.
Repeated pages are judged each. An empty list blocks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm import bloom
from rentlens.session import stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?`` or ``#``, ASCII letters lower-cased."""
    found = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host_column: Column, path_column: Column) -> Column:
    """Address that pages of one article share; null without a host."""
    bare = F.regexp_replace(host_column, r"^(?:www|m)\.", "")
    return F.when(host_column != "", F.concat(bare, F.regexp_replace(path_column, r"(?:/|\.html?)$", "")))


def _fits(rule: Rule, host_column: Column, path_column: Column) -> Column:
    on_host = (host_column == rule.host) | F.endswith(host_column, F.lit("." + rule.host))
    return on_host & F.startswith(path_column, F.lit(rule.path))


def matched(rules: list[Rule], host_column: Column, path_column: Column) -> Column:
    """The longest fitting rule as ``name`` and ``verdict``; null if none fits.

    Rules are a short policy list that becomes one expression; page lists go to the filter instead.
    """
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        found = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        fits = _fits(rule, host_column, path_column)
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def listed_flags(rows: DataFrame, key: str, listed: DataFrame, flag: str = "listed") -> DataFrame:
    """Rows with ``flag``: whether the address in ``key`` is among ``listed``'s column ``address``."""
    addresses = stage(listed.where(F.col("address").isNotNull()).select("address", F.xxhash64("address").alias("digest")).distinct(), "listed")
    bits = bloom.page_bits(addresses.count())
    pages = stage(bloom.build(addresses, "digest", bits), "listed-filter")
    asked = bloom.ask(rows.withColumn("_digest", F.when(F.col(key).isNotNull(), F.xxhash64(key))), "_digest", pages, bits, "_maybe").drop("_digest")
    possible = asked.where("_maybe").drop("_maybe")
    exact = addresses.select(F.col("address").alias("_address"))
    hits = possible.join(exact, F.col(key) == F.col("_address"), "left").withColumn(flag, F.col("_address").isNotNull()).drop("_address")
    return asked.where("not _maybe").drop("_maybe").withColumn(flag, F.lit(False)).unionByName(hits)


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    Rules decide first; other pages are blocked if their canonical address is listed.
    """
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = split.withColumn("found", matched(rules, F.col("host"), F.col("path")))
    open_pages = ruled.withColumn("address", F.when(F.col("found").isNull(), canonical(F.col("host"), F.col("path"))))
    flagged = listed_flags(open_pages, "address", listed)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return flagged.select("page_id", "host", "path", F.col("found.name").alias("rule"), verdict.alias("verdict"))


def repeated_addresses(pages: DataFrame, least: int = 2) -> DataFrame:
    """Canonical addresses that at least ``least`` pages share: a list for :func:`judge`."""
    address = canonical(host(F.col("url")), path(F.col("url")))
    return pages.select(address.alias("address")).where("address is not null").groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("address")
