"""Main text of pages: exact on the given pages, and on hand-made ones."""

import html
import re

from shelfline.llm import html_text
from shelfline.llm.common import table
from shelfline.llm.html_text import main_text


def article_of(page):
    """The article of the given pages, which share one template, by patterns alone."""
    body = re.search(r"<article>(.*?)(</article>|<footer>)", page, re.S)[1]
    body = re.sub(r"</?(h1|p)>", "\0", re.sub(r"<br>", " ", body))
    blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"</?[a-z][^>]*>", "", body).split("\0"))
    return "\n".join(b for b in blocks if b)


def test_query_gives_the_articles(spark, sf):
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    got = html_text.query(spark, sf).collect()
    assert len(got) == len(pages)
    for row in got:
        assert row.text == article_of(pages[row.page_id].html)
        assert row.url == pages[row.page_id].url and row.n_chars == len(row.text)


LONG = "some long sentence of the article that goes on for a while and then some more."


def test_boilerplate_goes_and_short_lines_stay():
    page = f"""<html><head><title>t</title></head><body><div id="site-header">Site</div><div class="mainNav">a b</div>
    <div class="wrap"><h1>Title</h1><div class="text"><p>{LONG}</p><ul><li>x<li>y z</ul><p>{LONG}&nbsp;&lt;b&gt;</div></div>
    <aside>side</aside><form>Search <input> <button>Go</button></form><div class="cookie-notice">We use cookies {LONG}</div>
    <section id="comments"><p>comment {LONG}</p></section><script>var a = "<p>no</p>";</script></body></html>"""
    assert main_text(page) == f"Title\n{LONG}\nx\ny z\n{LONG} <b>"


def test_article_with_nested_boilerplate():
    page = f"<article><header><h1>T</h1></header><p>{LONG} <span class='ad'>buy</span></p>loose<div class='related'>r</div><p>end</article><p>{LONG}</p>"
    assert main_text(page) == f"T\n{LONG}\nloose\nend"
    assert main_text("<article><p>a <em>b</em>c <i class='share'>d <b>e</b></i>f</article>") == "a bc f"


def test_white_space_and_entities():
    assert main_text("<article><p>a\n \t b&amp;c &#233;<!-- no --></p>\n<p> </p><p>d</p></article>") == "a b&c é\nd"


def test_edge_rows(spark):
    pages = [(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (4, "u", "<nav>only</nav>"), (5, "u", "<div>" * 500 + "deep"), (6, "u", "<p>" + "w " * 200_000)]
    rows = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    got = html_text.extract(rows.unionAll(rows)).collect()
    assert len(got) == 12
    texts = {r.page_id: r.text for r in got}
    assert (texts[1], texts[2], texts[None], texts[4], texts[5]) == ("", "", "x", "", "deep")
    assert len(texts[6]) == 399_999
    assert html_text.extract(rows.limit(0)).count() == 0
