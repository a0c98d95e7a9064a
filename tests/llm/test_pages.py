import random

from rentlens.llm import page_diff

SHAPE = "page_id long, url string, html string, text string, row int"


def test_structure_decides_what_is_article():
    html = """<head><title>t</title><style>p{}</style><body><nav><ul><li>menu</ul></nav><header>top</header><div class="cookie-notice">ok?</div>
    <article><h1>A&amp;B</h1><p><b>one  two.<br><p>three<!-- gone --> <script>x("</p>")</script>four</p><aside>side</aside><section class="comments"><article class="comment">me</article></section></article><footer>end</footer>"""
    assert page_diff.page_lines(html) == (["A&B", "one two.", "three four"], [True] * 3)
    assert page_diff.page_lines(None) == ([], []) and page_diff.page_lines("") == ([], [])
    assert page_diff.page_lines("<form><main>kept<input></main>out</form>")[0] == ["kept"]
    assert page_diff.page_lines("<![if x]><p>a</b></i>b<td>c<![endif]><!-- open <p>")[0][:2] == ["ab", "c"]


def test_longest_common_subsequence():
    draw = random.Random(1)

    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(300):
        a, b = ([draw.randint(0, 6) for _ in range(draw.randint(0, 14))] for _ in range(2))
        assert sum(page_diff.shared(a, b)) == length(a, b)


def test_lines_shared_with_the_nearest_page_go(spark):
    plain = lambda *lines: "<body>" + "".join(f"<div>{s}</div>" for s in lines)
    rows = [
        (1, "http://a.com/x/1", plain("top line", "first story", "end line")), (2, "http://a.com/x/2", plain("top line", "second story", "more of it", "end line")),
        (3, "http://a.com/y/1", plain("top line", "third story")), (4, "http://b.com/x/1", plain("top line", "alone")),
        (5, "http://c.com/1", "<p>menu</p><article>same</article>"), (6, "http://c.com/1", "<p>menu</p><article>same</article>"),
        (7, None, plain("no host")), (8, "http://d.com/", None), (8, "http://d.com/", None), (9, "http://e.com/", "<p>" + "long " * 200_000),
    ]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], SHAPE).repartition(4)
    out = page_diff.main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    text = {r.page_id: r.text for r in out.collect()}
    assert text[1] == "first story" and text[2] == "second story\n\nmore of it" and text[3] == "third story"
    assert text[4] == "top line\n\nalone" and text[5] == text[6] == "same" and text[7] == "no host" and text[8] == ""
    assert len(text[9]) == 999_999
    assert out.count() == len(rows)
    assert page_diff.main_text(pages.limit(0)).count() == 0


def test_copies_are_not_compared_with_each_other(spark):
    plain = lambda *lines: "<body>" + "".join(f"<div>{s}</div>" for s in lines)
    story, only = plain("top line", "a story", "end line"), plain("top line", "only copies")
    rows = [(1, "http://a.com/x?p=1", story), (2, "https://a.com/x?p=2", story), (2, "https://a.com/x?p=2", story), (3, "http://a.com/x/9", plain("top line", "other", "end line")),
            (4, "http://a.com/z", story), (5, "http://b.com/x", only), (5, "http://b.com/x", only), (6, "http://b.com/x?q", only)]
    out = page_diff.main_text(spark.createDataFrame([(*r, "t", 1) for r in rows], SHAPE).repartition(4)).collect()
    assert sorted((r.page_id, r.text) for r in out) == [
        (1, "a story"), (2, "a story"), (2, "a story"), (3, "other"), (4, "a story"), *[(i, "top line\n\nonly copies") for i in (5, 5, 6)]]


def test_neighbours_cross_task_borders(spark):
    rows = [(f"h{i // 200}.com", f"/{i:04d}", i) for i in range(600)]
    near = {r.row: r.near for r in page_diff.neighbours(spark.createDataFrame(rows, "host string, path string, row long").repartition(3)).collect()}
    assert len(near) == 600
    assert all(abs(a - b) == 1 and a // 200 == b // 200 for a, b in near.items())


def test_class_names_do_not_hide_an_article_or_its_title():
    lines = lambda html: page_diff.page_lines(html)[0]
    assert lines('<article class="widget"><p>a story</p></article>') == ["a story"]
    assert lines('<div class="content has-sidebar"><article><p>a story</p></article></div>') == ["a story"]
    assert lines('<article><h1 class="entry-header">title</h1><div class="header">by line</div><p>x<math>y</math></p></article>') == ["title", "by line", "xy"]
    assert lines('<div class="site-header">brand</div><div class="sidebar">links</div><p>story</p>') == ["story"]
    assert lines('<main><p>story</p><article class="comment">me too</article><div class="related"><article>other</article></div></main>') == ["story"]


def test_many_equal_lines_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    assert all(page_diff.shared([7] * 20_000, [7] * 20_000))
    assert sum(page_diff.shared([7, 8] * 5_000, [8, 7] * 5_000)) == 9_999
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert page_diff.shared([-1, -1, 3], [-1, 3, -1]) == [False, False, True]
