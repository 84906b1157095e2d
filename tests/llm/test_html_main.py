import time

import pytest

from narralith.llm import html_main as H

PAGE = (
    '<html><head><title>T</title><style>p</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>{}'
    '<div id="comments"><p>First comment here, rather long to win any score by its sheer length, on and on.</p></div><aside>Side</aside><footer>&copy; x</footer></body></html>'
)
ARTICLE = "<article><h1>Head&amp;line</h1><p><b>One.<br><p>Two  &lt;b&gt;\n three.</p><form>Name <input></form><ul><li>i1<li>i2</ul></article>"


def test_template():
    assert H.main_text(PAGE.format(ARTICLE), None) == "Head&line\n\nOne.\n\nTwo <b> three.\n\ni1\n\ni2"


@pytest.mark.parametrize("page,text", [("", ""), (None, ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<div class='x1'><p>a</p>b</div>", "a\n\nb"), ("<article><p>open", "open"), ("<!-- never ends <p>x</p>", ""), ("1 < 2 & 3 &gt; 2", "1 < 2 & 3 > 2")])
def test_odd_pages(page, text):
    assert H.main_text(page, None) == text


def test_general_path():
    assert H.general_path("/html/body", "div", ' class="b post-12 a"') == "/html/body/div.a.b.post-#"


def test_host_consensus(spark):
    body = '<html><body><div class="side-story"><p>{}</p></div><div class="post-{}"><p>{}</p></div></body></html>'
    rows = [(i, "http://h.example/x", body.format("s" * 20, i, f"main text {i} of some length, longer than the side one"), "old") for i in range(5)]
    # on its own this page would be read from the wrong container
    rows += [(5, "http://h.example/y", body.format("long side story " * 10, 7, "short"), "old"), (6, None, None, "old"), (7, "http://other/", "<p>only</p>", "old"), (7, "http://other/", "<p>only</p>", "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for limit in (32 << 20, 0):
        got = H.extract(df, broadcast_bytes=limit).orderBy("page_id").collect()
        assert [r.text for r in got] == [f"main text {i} of some length, longer than the side one" for i in range(5)] + ["short", "", "only", "only"]
        assert got[0].asDict().keys() == {"page_id", "url", "text"}


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("lead,body", [(40, 60), (60, 40), (20, 100), (100, 20)])
def test_article_in_nested_parts(spark, lead, body):
    page = '<html><body><div class="post"><div class="lead"><p>{}</p></div><div class="body"><p>{}</p></div></div></body></html>'
    a, b = "a" * lead, "b" * body
    assert H.main_text(page.format(a, b), None) == f"{a}\n\n{b}"
    df = spark.createDataFrame([(i, "http://n.example/", page.format(a, b)) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(df).collect()} == {f"{a}\n\n{b}"}


def test_two_templates_of_a_host(spark):
    first = '<html><body><div class="content"><p>{}</p></div></body></html>'
    other = '<html><body><div class="content"><p>short</p></div><div class="story"><p>{}</p></div></body></html>'
    rows = [(i, "http://t.example/", first.format(f"first template {i} " * 10)) for i in range(6)] + [(i, "http://t.example/", other.format(f"other template {i} " * 10)) for i in range(6, 8)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join([f"{'first' if i < 6 else 'other'} template {i}"] * 10) for i in range(8)}


@pytest.mark.parametrize("piece", ["<a ", "<a", "<script ", "</ ", "<!x ", "<div class='", '<p x="', "<!-- ", "<aaaa", "<a x=1 'b\" "])
def test_broken_pages_in_linear_time(piece):
    page = "<body><p>words here</p>" + piece * (1_000_000 // len(piece))
    at = time.time()
    for _ in H.walk(page):
        pass
    assert time.time() - at < 2


def test_very_deep_page():
    page = "<body>" + '<div class="level-one more">' * 5000 + "<p>deep text</p>"
    at = time.time()
    assert H.main_text(page, None) == "deep text"
    assert time.time() - at < 20
    assert len({H.general_path("/a" * 400, "p", ""), H.general_path("/a" * 399 + "/b", "p", "")}) == 2
