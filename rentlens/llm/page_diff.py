"""Main text of web pages: page structure, and differences between pages with the nearest addresses.

A page becomes lines, one for each block element. Lines of menus, headers, footers, sidebars, notices,
adverts, forms and comments go by tag, role and class name. Pages are then paired within a host: sorted by
path, each page is compared with the neighbour that shares the longer beginning of the path. The longest
common subsequence of their remaining lines is what the site repeats; those lines are deleted, except
inside a page's own ``article`` or ``main`` element, whose lines are the article by the page's own word. A
page that has such an element keeps nothing from outside it.

White space inside a line becomes one space and character references are decoded. A null, empty or broken
page gives empty text; unclosed elements end with their parents. Pages of a host with the same lines are one
page at their first address, so a page is never compared with its copies; where a host has nothing else, nothing
is deleted. Repeated rows are reported each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm.url_filter import host, path
from rentlens.llm.words import bounded_batches
from rentlens.session import stage

# --- fixed values: HTML elements by what they do to the text ---
SILENT = frozenset("script style noscript template iframe svg canvas object select button textarea form nav aside footer dialog head audio video".split())
BLOCKS = frozenset(
    "address article blockquote body head caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol "
    "nav aside footer form dialog option p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OWN = frozenset(["article", "main"])
WHOLE = frozenset(["form", "head"])  # silent, but an article in one still counts
HARD = 2
# elements whose start ends an open one of the same kind
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
          "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
# class names and ids of parts that are no article; a layout's "has-sidebar" is none, nor a title's "entry-header"
_PART = r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:{})(?:$|[\s_-])"
NAMES = re.compile(_PART.format(
    "ads?|adverts?|advertisement|banner|promo|sponsor(?:ed)?|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|social|"
    "comments?|disqus|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|related|recommended|widget|skip"), re.I)
HEADS = re.compile(_PART.format("header|masthead"), re.I)
TEASERS = re.compile(_PART.format("ads?|adverts?|advertisement|promo|sponsor(?:ed)?|comments?|disqus|related|recommended"), re.I)
_BLANK = re.compile(r"\s+")
_MARKED = re.compile(r"<!\[[^>]*>")  # browsers end such a section at the first >


class _Lines(HTMLParser):
    """Lines of a page and whether each is inside the page's own main element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.own: list[bool] = []
        self._open: list[tuple[str, int, bool]] = []  # tag, silence, own
        self._text: list[str] = []

    def _state(self) -> tuple[int, bool]:
        return self._open[-1][1:] if self._open else (0, False)

    def _flush(self) -> None:
        line = _BLANK.sub(" ", "".join(self._text)).strip()
        if line:
            self.lines.append(line)
            self.own.append(self._state()[1])
        self._text = []

    def _begin_block(self, tag: str) -> None:
        """End the open text and the elements that a block of this kind closes."""
        if tag == "body" or (self._open and self._open[-1][0] == "head"):
            self._open = [item for item in self._open if item[0] != "head"]
        kinds = CLOSES.get(tag, frozenset()) | {"p"}
        while any(t in kinds for t, _, _ in self._inline_run()):
            self._flush()
            self._open.pop()
        self._flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._begin_block(tag)
        elif tag == "br":
            self._text.append(" ")
        if tag in EMPTY:
            return
        silence, own = self._state()
        held = dict(attrs)
        words = [held[k] for k in ("class", "id") if held.get(k)]
        # an article is hidden only as a comment or a pointer to others; inside it, a header is its own
        kinds = () if tag in ("html", "body", "main") else (TEASERS,) if tag == "article" else (NAMES,) if own else (NAMES, HEADS)
        named = any(kind.search(word) for kind in kinds for word in words)
        if named or "hidden" in held or held.get("role") in ROLES or (tag in SILENT and tag not in WHOLE) or (tag == "header" and not own):
            silence = HARD
        elif tag in OWN:
            silence = HARD if silence == HARD else 0
        elif tag in WHOLE:
            silence = max(silence, 1)
        self._open.append((tag, silence, own or tag in OWN))

    def _inline_run(self) -> list[tuple[str, int, bool]]:
        """Open elements up to the nearest one that holds blocks."""
        run = []
        for item in reversed(self._open):
            if item[0] in BLOCKS and item[0] not in CLOSES:
                break
            run.append(item)
            if item[0] in CLOSES:
                break
        return run

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        reach = self._open if tag in BLOCKS or tag in SILENT else self._inline_run()
        if not any(t == tag for t, _, _ in reach):
            return
        while True:
            top = self._open[-1][0]
            if top in BLOCKS:
                self._flush()
            self._open.pop()
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self._text.append(data)


def page_lines(html: str | None) -> tuple[list[str], list[bool]]:
    """Lines outside silent elements; with a main element of the page's own, only the lines in it."""
    parser = _Lines()
    html = _MARKED.sub("", html or "")
    comment = html.rfind("<!--")
    parser.feed(html[:comment] if comment >= 0 and html.find("-->", comment) < 0 else html)
    parser.close()
    parser._flush()
    if any(parser.own):
        return [s for s, own in zip(parser.lines, parser.own) if own], [True] * sum(parser.own)
    return parser.lines, parser.own


def shared(lines: list[int], other: list[int]) -> list[bool]:
    """Which of ``lines`` are in a longest common subsequence with ``other``; negative ones match nothing.

    One whole number holds a row of the table, a bit for each line of ``other``: a clear bit stands for a step up. Rows are
    kept at the beginnings of blocks and made again block by block on the way back, so memory is the root
    of the table.
    """
    places: dict[int, int] = {}
    for j, line in enumerate(other):
        if line >= 0:
            places[line] = places.get(line, 0) | 1 << j
    every = (1 << len(other)) - 1
    block = max(int(len(lines) ** 0.5), 1)

    def row_after(row: int, line: int) -> int:
        common = row & places.get(line, 0)
        return ((row + common) | (row - common)) & every

    kept, row = [], every
    for i, line in enumerate(lines):
        if i % block == 0:
            kept.append(row)
        row = row_after(row, line)
    out, column = [False] * len(lines), len(other)
    for begin in range((len(kept) - 1) * block, -1, -block):
        rows = [kept[begin // block]]
        for line in lines[begin : begin + block]:
            rows.append(row_after(rows[-1], line))
        for i in range(len(rows) - 2, -1, -1):
            # the last step up at or before the column; without one nothing is left to match
            clear = ~rows[i + 1] & ((1 << column) - 1)
            if not clear:
                return out
            column = clear.bit_length()
            if rows[i] >> (column - 1) & 1:  # the step is new in this row: its line matches there
                out[begin + i] = True
                column -= 1
    return out


def _split(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``lines``, ``marks`` (digests of lines that may be deleted; -1 for others)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_lines(html) for html in batch.column(4).to_pylist()]
            marks = [[-1 if kept else xxhash.xxh3_64_intdigest(s) >> 1 for s, kept in zip(*page)] for page in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([p[0] for p in found], pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))],
                                             [*batch.schema.names[:4], "lines", "marks"])

    shape = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()),
                          T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("marks", T.ArrayType(T.LongType()))])
    return bounded_batches(pages).select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html").mapInArrow(rows, shape)


def neighbours(pages: DataFrame) -> DataFrame:
    """``row`` and ``near``: for each page the next page on its host by path that shares the longer beginning.

    Pages are sorted by range over the whole table, so a large host lies in many tasks; only the first and
    last page of each task are matched again.
    """
    ordered = pages.select("host", "path", "row").where("host <> ''").repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    placed = stage(ordered.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "page-order")
    inner = Window.partitionBy("task").orderBy("at")
    ends = placed.groupBy("task").agg(F.min_by(F.struct("host", "path", "row"), "at").alias("first"), F.max_by(F.struct("host", "path", "row"), "at").alias("last"))
    # two rows for each task of the sort
    outer = Window.orderBy("task")
    ends = ends.select(F.col("task").alias("_task"), F.lag("last").over(outer).alias("before"), F.lead("first").over(outer).alias("after"))
    around = placed.join(F.broadcast(ends), F.col("task") == F.col("_task"))
    here = F.struct("host", "path", "row")
    around = around.select("host", "path", "row", F.coalesce(F.lag(here).over(inner), "before").alias("before"), F.coalesce(F.lead(here).over(inner), "after").alias("after"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, near = [], []
            for page in batch.to_pylist():
                sides = [s for s in (page["before"], page["after"]) if s and s["host"] == page["host"]]
                if sides:
                    rows.append(page["row"])
                    near.append(max(sides, key=lambda s: len(commonprefix([s["path"], page["path"]])))["row"])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(near, pa.int64())], ["row", "near"])

    return around.mapInArrow(nearest, "row long, near long")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    split = stage(_split(pages).withColumns({"row": F.monotonically_increasing_id(), "look": F.xxhash64("lines")}), "page-lines")
    firsts = split.where("host <> ''").groupBy("host", "look").agg(F.min(F.struct("path", "row")).alias("first"))
    firsts = stage(firsts.select("host", "look", "first.path", "first.row"), "page-firsts")
    pairs = neighbours(firsts).join(firsts.select("row", "host", "look"), "row").select("host", "look", "near")
    # only line digests move; pages whose lines are all their own have nothing to delete
    open_pages = split.where(F.exists("marks", lambda m: m >= 0))
    asked = open_pages.select("host", "look", "row", "marks").join(pairs, ["host", "look"]).select("row", "marks", "near")
    others = split.select(F.col("row").alias("near"), F.col("marks").alias("other"))

    def deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [[i for i, hit in enumerate(shared(a, b)) if hit and a[i] >= 0] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])

    gone = stage(asked.join(others, "near").select("row", "marks", "other").mapInArrow(deletions, "row long, gone array<int>").where(F.size("gone") > 0), "page-deletions")
    kept = F.filter("lines", lambda line, i: ~F.array_contains("gone", i))
    changed = split.join(gone, "row").select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))
    same = split.join(gone.select("row"), "row", "left_anti").select("page_id", "url", F.array_join("lines", "\n\n").alias("text"))
    return same.unionByName(changed).withColumn("n_chars", F.length("text").cast("long"))
