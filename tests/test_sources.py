"""Files, pages, tables."""

import pytest

from rentlens import vocab
from rentlens.sources import pages as P
from rentlens.sources.csv_files import first_existing, read_listings_csv
from rentlens.sources.tables import save_table

RENDERED = """<html><body><div class="font-semibold text-3xl x">Nice villa</div>
<span class="text-2xl text-error-500">$500/month</span>
<span class="flex gap-x-1 items-center">1</span><span class="flex gap-x-1 items-center"> Khan A, Phnom Penh </span>
<p class="text-base/8">3 bathrooms<br>fully furnished</p>
<div class="grid gap-x-6 gap-y-4 grid-cols-4"><dl><dt>បន្ទប់គេង</dt><dd>4</dd></dl><dl><dt>ទំហំ</dt><dd>35m²</dd></dl></div></body>"""
STATIC = """<div class="grid gap-x-6 gap-y-4 grid-cols-4"><div class="flex gap-x-3"><div>House</div><div>40 m²</div></div></div>
<div>99 m²</div><p class="text-sm">Street 1"""
PORTAL = """<h1 class="heading">House</h1><span class="value">$900</span><div class="css-r7o7s2">
<div><span class="value">3</span><span class="text">Bedrooms</span></div>
<div><span class="value">120 m²</span><span class="text">Floor Area</span></div>
<div><span class="value">200 m²</span><span class="text">Land Area</span></div></div>"""


def test_csv_encodings_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿a,b,c\n1,2,ទំ\n4,5,6,7\n8,9\n1,2,3,4,5\n".encode())
    (tmp_path / "b.csv").write_bytes("a,b,c\n2,café €,3\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("a,b,c\n3,caf\xe9 \x81,3\n".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes('a,b,c\n4,"x, ""y""",é\n'.encode())
    df = read_listings_csv(spark, ["/no/such/place", str(tmp_path)], ["a", "z"])
    assert sorted(df.collect(), key=lambda r: r["a"]) == [
        ("1", "2", "ទំ", None), ("2", "café €", "3", None), ("3", "caf\xe9 \x81", "3", None), ("4", 'x, "y"', "é", None),
        ("8", "9", None, None)]


def test_quoted_line_breaks_and_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"two\nlines",3\n')
    (tmp_path / "b.csv").write_text("c,a\n6,4\n")
    (tmp_path / "empty.csv").write_text("")
    rows = read_listings_csv(spark, str(tmp_path)).select("a", "b", "c").collect()
    assert sorted(rows) == [("1", "two\nlines", "3"), ("4", None, "6")]


def test_no_source(spark):
    with pytest.raises(FileNotFoundError):
        first_existing(spark, ["/no/such/a", "/no/such/b"])


def test_page_layouts():
    page = P.parse_page(RENDERED, P.RENDERED_SITE)
    assert (page["title"], page["price"], page["location"]) == ("Nice villa", "$500/month", "Khan A, Phnom Penh")
    assert (page["bedrooms"], page["size"], page["description"]) == ("4", "35m²", "3 bathrooms fully furnished")
    page = P.parse_page(STATIC, P.STATIC_SITE)
    assert (page["type"], page["size"], page["address"], page["title"]) == ("House", "40 m²", "Street 1", None)
    page = P.parse_page(PORTAL, P.PORTAL_SITE)
    assert (page["price"], page["bedrooms"], page["size"], page["land_area"]) == ("$900", "3", "120 m²", "200 m²")


def test_listing_rows_and_ids(spark):
    pages = spark.createDataFrame([(1, "http://x/adid-5", RENDERED), (2, "http://x/other", RENDERED)], "page_id long, url string, html string")
    rows = P.unify_sources([P.listing_rows(P.extract_fields(pages, P.RENDERED_SITE))]).sort("source_url").collect()
    first = rows[0]
    assert (first["listing_id"], first["bathrooms"], first["furnished"], first["city"]) == ("5", "3", "Fully Furnished", "Phnom Penh")
    assert len(rows[1]["listing_id"]) == 32


def test_links_of_a_class(spark):
    html = ('<a class="x post" href="/a">1</a><A HREF="http://b/c" class="post">2</A><a href="/d">3</a>'
            '<a class="post" href="mailto:x">4</a><a class="post" href="/a">5</a><abbr class="post" href="/no">')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    links = P.extract_links(pages, "https://s", "post").collect()
    assert sorted(r["link"] for r in links) == ["http://b/c", "https://s/a"]
    assert P.extract_links(pages, "https://s").count() == 3


def test_links_as_browsers_read_them(spark):
    html = """<!-- <a href="/gone">x</a> --><a data-href="/no">n</a><a href=/bare>b</a><a title=">" href='/q?a=1&amp;b=2'>q</a>
    <script>var s = '<a href="/js">';</script><a href="/first" href="/second">f</a><a>none</a>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert sorted(r["link"] for r in P.extract_links(pages, "https://s").collect()) == ["https://s/bare", "https://s/first", "https://s/q?a=1&b=2"]
    titles = spark.createDataFrame([(1, "<title> A &amp; B </title>"), (2, None), (3, "<title></title>")], "page_id long, html string")
    assert [r["title"] for r in P.page_titles(titles).sort("page_id").collect()] == ["A & B", None, None]


def test_last_label_counts():
    cells = "<dl><dt>SIZE</dt><dd>1</dd></dl><dl><dt>Floor size</dt><dd>2</dd></dl><dl><dt>TYPE</dt><dd>x</dd></dl>"
    page = P.parse_page(f'<div class="grid gap-x-6 gap-y-4 grid-cols-4">{cells}</div>', P.RENDERED_SITE)
    assert page["size"] == "2" and page["type"] is None


def test_keywords_of_each_site(spark):
    fields = spark.createDataFrame([("semi furnished",)], "description string").selectExpr(
        *[f"cast(null as string) as {c}" for c in [*P.FIELDS, *P.LABELLED, "url"] if c != "description"], "description")
    assert P.listing_rows(fields, P.RENDERED_SITE).first()["furnished"] == "Partly Furnished"
    assert P.listing_rows(fields, P.PORTAL_SITE).first()["furnished"] == "Unknown"


def test_save_table_may_read_its_own_target(spark, tmp_path):
    path = str(tmp_path / "t")
    save_table(spark.range(3).toDF("x"), path)
    save_table(spark.read.parquet(path).selectExpr("x + 1 as x"), path)
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_vocabularies():
    assert len(vocab.MODEL_FEATURES) == 33 and len(vocab.MODEL_TYPES) == 11 and len(vocab.BAND_LABELS) == 10


def _csv_text(draw, rows):
    """CSV text and the records it holds."""
    lines, records = ["a,b,c"], []
    for i in range(rows):
        value = "".join(draw.choices(["x", "\n", '"', ",", "é", " ", "\r\n", "long " * 40], k=draw.randint(0, 6)))
        cells = [str(i), value, draw.choice(["", "z", 'in"ner', "q"])]
        written = [c if j != 1 else '"' + c.replace('"', '""') + '"' for j, c in enumerate(cells)]
        lines.append(",".join(written) + draw.choice(["", "\r"]))
        records.append(lines[-1].rstrip("\r"))
        if draw.random() < 0.1:
            lines.append(draw.choice(["", "\r"]))
    return "\n".join(lines) + draw.choice(["", "\n"]), records


@pytest.mark.parametrize("size", ["97b", "1k", "1m"])
def test_records_of_byte_ranges_equal_the_whole_file(spark, tmp_path, size):
    import random

    from rentlens.sources.csv_ranges import csv_records

    draw = random.Random(size)
    expected = []
    for name in "pq":
        text, records = _csv_text(draw, 300)
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        expected += records
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, size)
    try:
        rows = csv_records(spark, [str(tmp_path)])
        assert size == "1m" or rows.rdd.getNumPartitions() > 20
        found = rows.collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert sorted(r.record.encode("latin-1").decode() for r in found if not r.first) == sorted(expected)
    assert [r.record for r in found if r.first] == ["a,b,c"] * 2


def test_values_of_byte_ranges_equal_the_built_in_reader(spark, tmp_path):
    import random

    text, _ = _csv_text(random.Random(5), 400)
    text = text.replace("\r", "")  # the built-in reader keeps them at the end of a record
    (tmp_path / "a.csv").write_bytes(text.encode())
    whole = spark.read.csv(str(tmp_path / "a.csv"), header=True, quote='"', escape='"', multiLine=True).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = read_listings_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(str, rows)) == sorted(map(str, whole))


def test_files_that_end_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"open\nnever closed\n')
    (tmp_path / "b.csv").write_text('a,b\n2,x"y"z\n3,"v"w,4\n')
    rows = read_listings_csv(spark, str(tmp_path)).collect()
    assert {r.a for r in rows} >= {"2"} and len(rows) == 2


def test_column_presence(spark):
    from rentlens.operators.clean import column_presence

    rows = column_presence(spark.range(3), ["id", "x"]).collect()
    assert sorted(map(tuple, rows)) == [("id", True, 3), ("x", False, None)]


def test_links_by_columns_equal_the_parser(spark):
    """Odd markup of every kind, next to plain pages."""
    import random

    draw = random.Random(12)
    bits = ['<a href="/x{i}">t</a>', "<A HREF='/y{i}' class=k>", "<a class='b' href=/z{i}>", "<a href=\"/q?a=1&amp;b={i}\">", "<a href = \" /w{i} \">", "<a>", "<abbr>", "<p title=\"a > b <a href='/no'>\">",
            "<!-- <a href='/no'> -->", "<!-- open <a href='/no'>", "<script>var s = '<a href=\"/no\">'</script>", "<style>a{}</style>", "<script>", "<textarea><a href=/no></textarea>", "<a href=\"/first\" href=\"/second\">",
            "<a data-href=/no href=/yes{i}>", "<a title=\"x href=/no\" href=/ok{i}>", "<a href=\"/broken>text", "<a href=''>", "<a href>", "<a\nhref=\"http://h/{i}\"\n>", "<a href=\"/slash/\"/>", "<title>a <a href=/t></title>", "<a href=/e>é</a>",
            "< a href=/no>", "<a/href=/s{i}>", "plain text ", "<![CDATA[<a href=/c>]]>", "<a href=`/b`>", "<a href=\"/u\"title=z>"]
    pages = [(i, "".join(draw.choices(bits, k=draw.randint(0, 5))).replace("{i}", str(draw.randint(0, 9)))) for i in range(1500)] + [(9000, None), (9001, "")]
    pages += [(9100 + i, b.replace("{i}", "1")) for i, b in enumerate(bits)] + [(9500, '<a href="/x">' * 20_000), (9501, "<a " + "k=v " * 20_000 + "href=/far>")]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(4)
    key = lambda rows: sorted((r.page_id, r.href) for r in rows)
    got, want = key(P._hrefs(df).collect()), key(P._parsed_hrefs(df, None).collect())
    odd = sorted(set(got) ^ set(want))
    assert got == want, [(p, [h for i, h in pages if i == p[0]][0][:200]) for p in odd[:3]]


def test_malformed_file_is_written_by_many_tasks(spark, small):
    import glob

    from rentlens.catalog import cleaning
    from rentlens.session import shared_folder

    folders = lambda: set(glob.glob(shared_folder(spark).removeprefix("file://") + "/rentlens/broken-*"))
    before = folders()
    rows = cleaning.QUERIES["read_malformed_csv"](spark, small)
    want = spark.read.parquet(f"{small}/orders.parquet").where("o_orderkey % 7 <> 0 and o_orderkey % 13 <> 11")
    assert rows.count() == want.count() and rows.select("listing_id").distinct().count() == rows.count()
    assert rows.where("listing_id is null or listing_id = 'listing_id' or not contains(note, '\n')").isEmpty()
    made = [f for d in folders() - before if "rows" not in d for f in glob.glob(f"{d}/part-*")]
    assert len(made) > 1
    assert all(open(f).readline() == "listing_id,note,size_sqm\n" for f in made)
