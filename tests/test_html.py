"""Trees, selectors, markdown, main content and links."""

import pytest

from webloom.functions import html, markdown
from webloom.functions.htmltree import parse, squeeze
from webloom.functions.selectors import compile_selector, select

PAGE = """<!doctype html><html><head><title> A &amp; B </title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/n">nav</a></li></ul></nav><div class="ad box">buy</div>
<article id="a1" class="post big"><h1>Head <em>line</em></h1><p>First, a paragraph with enough words, and a <a href="/x">link</a> in it.
<p>Second, <b>bold</b> and <code>code</code>, and enough words to be counted too, really.<ul><li>one<li>two <i>x</i></ul>
<blockquote><p>q1</p><p>q2</p></blockquote><pre>a
 b</pre><ol><li>n1</li><li>n2</li></ol><table><tr><th>h</th><td>v</td></tr><tr><td>1</td></tr></table><hr><img src="i.png" alt="pic"></article>
<footer>foot</footer></body></html>"""


def test_implied_ends():
    r = parse("<p>a<p>b<ul><li>x<li>y</ul><p><b>c<br><p>d</p>e")
    assert [squeeze(p.text()) for p in r.walk() if p.tag == "p"] == ["a", "b", "c", "d"]
    assert [n.text() for n in r.walk() if n.tag == "li"] == ["x", "y"]
    t = parse("<table><tr><td>1<td>2<tr><td>3</table>")
    assert [[d.text() for d in r.children] for r in t.walk() if r.tag == "tr"] == [["1", "2"], ["3"]]
    assert [n.text() for n in parse("<noscript><p>x</p></noscript>").walk()] == ["<p>x</p>"]


@pytest.mark.parametrize(
    ("css", "want"),
    [("h1", 1), ("#a1", 1), (".post", 1), (".post.big", 1), ("article > p", 2), ("article li", 4), ("article ol li, h1", 3), ("a[href]", 2), ("a[href='/x']", 1), ("a[href^='/']", 2), ("div.ad", 1), ("body *[class~=big]", 1), ("nope", 0)],
)
def test_selectors(css, want):
    assert len(select(parse(PAGE), css)) == want


def test_unknown_selector():
    with pytest.raises(ValueError, match="selector"):
        select(parse(PAGE), "a:hover")


def test_main_content():
    title, text = markdown.extract_main(PAGE)
    assert title == "A & B"
    assert text.split("\n\n") == [
        "# Head *line*", "First, a paragraph with enough words, and a [link](/x) in it.", "Second, **bold** and `code`, and enough words to be counted too, really.", "- one\n- two *x*",
        "> q1\n>\n> q2", "```\na\n b\n```", "1. n1\n2. n2", "| h | v |\n| --- | --- |\n| 1 |  |", "* * *", "![pic](i.png)",
    ]
    assert "nav" not in text and "foot" not in text and "buy" not in text


def test_selector_markdown():
    assert markdown.extract_selector(PAGE, "h1, article > ul li") == "# Head *line*\n\n- one\n\n- two *x*"
    assert markdown.extract_selector(PAGE, "aside") == ""
    assert markdown.extract_main("")[1] == "" and markdown.extract_main("plain")[1] == "plain"


def test_links():
    page = '<a href="/about">1</a><a href="https://example.com/x">2</a><a href="../other">3</a><a href="javascript:f()">4</a><a href="mailto:a@b">5</a><a href="tel:1">6</a><a href="#s">7</a><a href="https://ext.test/">8</a><a>9</a>'
    assert html.links_of(page, "https://example.com/docs/page") == ["https://example.com/about", "https://example.com/x", "https://example.com/other", "https://ext.test/"]


def test_signals_count_nested_text_again():
    s = html.signals_of("<main><p>hello world, this is long enough</p></main><script>ab</script>")
    assert s["visible"] == "hello world, this is long enough " * 1 + "hello world, this is long enough"
    assert (s["meaningful"], s["script_bytes"]) == (1, 2)


def test_one_parse_a_page(spark, monkeypatch):
    """Signals, links and content of a page come from one tree."""
    from pyspark.sql import functions as F

    seen = []
    real = html.parse
    monkeypatch.setattr(html, "parse", lambda p: seen.append(p) or real(p))
    monkeypatch.setattr(markdown, "parse", lambda p: seen.append(p) or real(p))
    pages = [PAGE, "<p>x", "", None]
    got = [html.page_of(p, "http://h/", ("signals", "links", "main")) for p in pages]
    assert seen == pages[:3]
    assert got[0]["links"] == ["http://h/n", "http://h/x"] and (got[0]["title"], got[0]["markdown"]) == markdown.extract_main(PAGE) and got[3] == {}
    monkeypatch.undo()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    rows = df.select("i", html.read_page(F.lit("http://h/"), F.col("html"), "links", "main", "signals").alias("p"), html.html_signals(F.col("html")).alias("s")).orderBy("i").collect()
    assert rows[3].p is None and [r.p.links for r in rows[:3]] == [["http://h/n", "http://h/x"], [], []]
    assert all(r.p.markdown == markdown.extract_main(p)[1] and all(r.p[k] == r.s[k] for k in r.s.asDict()) for r, p in zip(rows, pages[:3], strict=False))


def test_batches_of_pages_are_bounded_by_bytes(spark):
    """A worker is given no more than about a megabyte of pages at once, however many rows a partition has."""
    import pandas as pd
    from pyspark.sql import functions as F

    from webloom.functions import html

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    size = html._udf(lambda pages: pd.Series([len(pages)] * len(pages)), "int")
    pages = spark.range(0, 1000, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 10_000)).alias("html"))
    assert pages.select(size(F.col("html")).alias("n")).agg(F.max("n")).first()[0] < 200
