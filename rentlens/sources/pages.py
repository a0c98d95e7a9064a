"""Listings from stored web pages: links and fields."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.operators import clean as C

# --- fixed values: page layouts; classes name an element, ``labels`` maps label text to a field:
# words as written, then words in any case ---
STATIC_SITE = {
    "title": {"classes": "font-semibold text-3xl"},
    "price": {"classes": "text-error-500 text-2xl"},
    "location": {"classes": "flex gap-x-1 items-center", "index": 1},
    "address": {"classes": "text-sm"},
    "cells": {"tag": "div", "inside": "grid gap-x-6 gap-y-4 grid-cols-4"},
    "cell_texts": [("size", "contains", ["m²"]), ("type", "startswith", ["Room For Rent", "House", "Condo"])],
}
RENDERED_SITE = {
    "title": {"classes": "font-semibold text-3xl"},
    "price": {"classes": "text-error-500 text-2xl"},
    "location": {"classes": "flex gap-x-1 items-center", "index": 1},
    "address": {"classes": "text-sm"},
    "description": {"tag": "p", "classes": "text-base/8"},
    "pairs": {"label": {"tag": "dt", "inside": "grid gap-x-6 gap-y-4 grid-cols-4"},
              "value": {"tag": "dd", "inside": "grid gap-x-6 gap-y-4 grid-cols-4"}},
    "labels": [
        ("bedrooms", ["បន្ទប់គេង"], []),
        ("bathrooms", ["បន្ទប់ទឹក"], []),
        ("size", ["ទំហំ"], ["size"]),
        ("type", ["ប្រភេទ", "type", "Type"], []),
    ],
    "furnished": vocab.FURNISHED_KEYWORDS,
}
PORTAL_SITE = {
    "title": {"classes": "heading"},
    "price": {"classes": "value"},
    "description": {"classes": "css-zrj3zm"},
    "pairs": {"label": {"tag": "span", "classes": "text", "inside": "css-r7o7s2"},
              "value": {"tag": "span", "classes": "value", "inside": "css-r7o7s2"}, "value_first": True},
    "labels": [
        ("bedrooms", ["Bedroom"], []),
        ("bathrooms", ["Bathroom"], []),
        ("size", [], ["floor area"]),
        ("land_area", [], ["land area"]),
    ],
    "furnished": vocab.PORTAL_FURNISHED_KEYWORDS,
}
FIELDS = ["title", "price", "location", "address", "description"]
LABELLED = ["bedrooms", "bathrooms", "size", "type", "land_area"]
VOID_TAGS = {"br", "hr", "img", "input", "link", "meta", "source", "wbr"}


class _Anchors(HTMLParser):
    """Address and classes of each anchor. Comments and scripts hold none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            held = dict(reversed(attrs))  # of a repeated attribute the first counts
            self.found.append(((held.get("href") or "").strip(), (held.get("class") or "").split()))


# tags and attributes as nearly all pages write them; whatever else holds an anchor goes through the parser
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++)"""
_ATTRIBUTE = rf"""[^\s"'<>/=]++(?:\s*+=\s*+{_VALUE})?+"""
_ANCHOR = rf"(?i)<a(?:\s++{_ATTRIBUTE})*+\s*+>"
_HREF = rf"""(?is)\A<a(?:\s++(?!href[\s=>]){_ATTRIBUTE})*+\s++href\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>=`]++))"""
_SILENT = r"(?is)<!--.*?-->|<(script|style)(?:\s[^<>]*)?>.*?</\1\s*>"
# a value that holds < or an unclosed quote, sections and elements whose content is no markup, an open comment
_ODD = r"""(?is)=\s*+(?:"[^"]*[<>]|'[^']*[<>])|<(?:script|style|textarea|title[^>]*>[^<]*<(?!/title)|xmp|iframe|noembed|noframes|noscript|plaintext|!--|!\[|\?)"""


def _parsed_hrefs(pages: DataFrame, link_class: str | None) -> DataFrame:
    """``page_id, href`` of every anchor, by a parser."""
    schema = StructType([pages.schema["page_id"], StructField("href", StringType())])

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Anchors()
                parser.feed(html or "")
                parser.close()
                rows += [(page_id, href) for href, classes in parser.found if link_class is None or link_class in classes]
            yield pd.DataFrame(rows, columns=["page_id", "href"])

    return pages.select("page_id", "html").mapInPandas(anchors, schema)


def _hrefs(pages: DataFrame) -> DataFrame:
    """``page_id, href`` of every anchor: by column functions where a page's anchors are plainly written, else by the parser.

    Plain means that every ``<a`` outside comments, scripts and styles is a whole tag of ordinary attributes, and no
    address has a character reference.
    """
    tags = C.evaluate_once(pages.select("page_id", "html"), {"bare": F.regexp_replace("html", _SILENT, " ")})
    tags = C.evaluate_once(tags, {"tags": F.regexp_extract_all("bare", F.lit(_ANCHOR), F.lit(0))})
    begun = F.regexp_count("bare", F.lit(r"(?i)<a(?=[\s/>])"))
    referred = F.exists("tags", lambda t: F.contains(t, F.lit("&")))
    plain = (begun == F.size("tags")) & ~F.regexp_like("bare", F.lit(_ODD)) & ~referred
    tags = C.evaluate_once(tags, {"plain": F.coalesce(plain, F.lit(False))})
    part = lambda t, i: F.regexp_extract(t, _HREF, i)
    href = F.transform("tags", lambda t: T.strip(F.concat(part(t, 1), part(t, 2), part(t, 3))))
    # either side reads the pages; a page with an odd anchor is parsed whole
    quick = tags.where("plain").select("page_id", F.explode(href).alias("href"))
    return quick.unionByName(_parsed_hrefs(tags.where(~F.col("plain") & F.col("html").isNotNull()), None))


def extract_links(pages: DataFrame, base_url: str, link_class: str | None = None) -> DataFrame:
    """Distinct absolute links of each page's anchors: ``page_id, link``.

    ``/x`` is completed with the base address, ``http*`` is kept, anything else is dropped.
    """
    hrefs = _hrefs(pages) if link_class is None else _parsed_hrefs(pages, link_class)
    href = F.col("href")
    link = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base_url), href)).when(
        F.startswith(href, F.lit("http")), href
    )
    return hrefs.select("page_id", link.alias("link")).where(F.col("link").isNotNull()).dropDuplicates()


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


def page_titles(pages: DataFrame) -> DataFrame:
    """Text of the title tag, character references decoded, null if there is none."""
    found = T.strip(_unescaped(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return pages.select("page_id", F.nullif(found, F.lit("")).alias("title"))


class _Elements(HTMLParser):
    """Collects the text of the elements that a layout names, in document order."""

    def __init__(self, wanted: Mapping[str, Mapping]):
        super().__init__(convert_charrefs=True)
        self.wanted = {
            n: (r.get("tag"), set(r.get("classes", "").split()), set(r.get("inside", "").split()))
            for n, r in wanted.items()
        }
        self.open: list[tuple[str, set[str], list[list[str]]]] = []
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        texts = []
        for name, (want_tag, want_classes, inside) in self.wanted.items():
            fits = (want_tag is None or want_tag == tag) and want_classes <= classes
            if fits and (not inside or any(inside <= outer for _, outer, _ in self.open)):
                texts.append([])
                self.found.append((name, texts[-1]))
        if tag not in VOID_TAGS:
            self.open.append((tag, classes, texts))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if data.strip() and not (self.open and self.open[-1][0] in ("script", "style")):
            for _, _, texts in self.open:
                for text in texts:
                    text.append(data.strip())


def parse_page(html: str, rules: Mapping) -> dict[str, str | None]:
    """Fields of one page by a layout; an absent field is None."""
    wanted = {f: rules[f] for f in FIELDS if f in rules}
    wanted |= {"pair label": rules["pairs"]["label"], "pair value": rules["pairs"]["value"]} if "pairs" in rules else {}
    wanted |= {"cell": rules["cells"]} if "cells" in rules else {}
    parser = _Elements(wanted)
    parser.feed(html)
    out: dict[str, str | None] = dict.fromkeys([*FIELDS, *LABELLED])
    for field in FIELDS:
        hits = [texts for name, texts in parser.found if name == field]
        index = rules.get(field, {}).get("index", 0)
        if len(hits) > index:
            out[field] = (" " if field == "description" else "").join(hits[index])
    for cell in ("".join(texts) for name, texts in parser.found if name == "cell"):
        for field, how, words in rules["cell_texts"]:
            if any(w in cell if how == "contains" else cell.startswith(w) for w in words):
                out[field] = cell
                break
    value_first = rules.get("pairs", {}).get("value_first", False)
    pending = None
    for name, texts in parser.found:
        if name not in ("pair label", "pair value"):
            continue
        is_first = name == ("pair value" if value_first else "pair label")
        if is_first:
            pending = "".join(texts)
        elif pending is not None:
            label, value = ("".join(texts), pending) if value_first else (pending, "".join(texts))
            for field, words, any_case in rules["labels"]:
                if any(w in label for w in words) or any(w in label.lower() for w in any_case):
                    out[field] = value  # the last of equal labels counts
                    break
            pending = None
    return out


def extract_fields(pages: DataFrame, rules: Mapping) -> DataFrame:
    """Raw listing fields of each page. A page that cannot be parsed gives no row."""
    names = [*FIELDS, *LABELLED]
    schema = StructType([*[f for f in pages.schema if f.name in ("page_id", "url")],
                         *[StructField(n, StringType()) for n in names]])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                try:
                    rows.append({"page_id": page_id, "url": url, **parse_page(html, rules)})
                except (AssertionError, TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["page_id", "url", *names])

    return pages.select("page_id", "url", "html").mapInPandas(parse, schema)


def listing_rows(fields: DataFrame, rules: Mapping | None = None) -> DataFrame:
    """Extracted fields as raw listings: attributes missing from the page come from its description.

    ``rules`` is the layout the fields come from; its furnishing keywords are used.
    """
    keywords = (rules or {}).get("furnished", vocab.FURNISHED_KEYWORDS)
    text = F.coalesce("description", F.lit(""))
    pick = lambda name, column: F.coalesce(F.col(column), T.first_match(text, vocab.DESCRIPTION_PATTERNS[name]))
    return fields.select(
        F.col("price").alias("rent_price_usd"), T.last_token(F.col("location")).alias("city"),
        F.col("location").alias("district"), F.col("type").alias("property_type"),
        pick("size_sqm", "size").alias("size_sqm"), pick("bedrooms", "bedrooms").alias("bedrooms"),
        pick("bathrooms", "bathrooms").alias("bathrooms"), T.furnished_from_text(F.col("description"), keywords).alias("furnished"),
        "title", "address", "land_area", F.col("url").alias("source_url"),
    )


def map_columns(df: DataFrame, names: Mapping[str, str] = vocab.COLUMN_NAMES) -> DataFrame:
    """Rename logical to physical columns; columns without a mapping stay."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def listing_id_of(url: Column) -> Column:
    """Number after ``adid-`` at the end of an address, else a digest of the address."""
    number = F.nullif(F.regexp_extract(url, r"adid-(\d+)$", 1), F.lit(""))
    return F.coalesce(number, F.md5(url.cast("binary")))


def unify_sources(sources: Sequence[DataFrame], names: Mapping[str, str] = vocab.COLUMN_NAMES) -> DataFrame:
    """All sources as one table; a column one of them lacks is null there. Adds ``listing_id``."""
    out, *others = [map_columns(s, names) for s in sources]
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    if "listing_id" in out.columns:
        out = out.withColumnRenamed("listing_id", "known_id")
        return out.withColumn(
            "listing_id", F.coalesce(F.col("known_id").cast("string"), listing_id_of(F.col("source_url")))
        ).drop("known_id")
    return out.withColumn("listing_id", listing_id_of(F.col("source_url")))
