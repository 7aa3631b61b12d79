import os
import time
from html.parser import HTMLParser

import pytest

from lexgrid.llm import html_extract as h

LONG = "This is a long paragraph of main text with many words in it, enough to be taken for content. " * 3
TEXT = LONG.strip()


def test_article_without_surroundings():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now please.</div>
    <article><h1>Tom &amp; Jerry</h1><p><b>One\n  two<br>three<p>Be.</p><div class="advert">Buy</div><p>x &lt; y&nbsp;z</p>
    <section id="comments"><p>A reader says that this is a fine text of some length and more</p></section></article>
    <aside>Else</aside><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""
    assert h.main_text(page) == "Tom & Jerry One two three Be. x < y z"


def test_page_without_article_uses_words_and_links():
    body = "This is a long paragraph of main text with many words in it, enough to be taken for content. " * 3
    page = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>More</a></li></ul>" + f"<div><p>{body}</p><p>{body}</p></div>"
    assert h.main_text(page) == " ".join((body + body).split())


def test_unclosed_advert_before_article_and_odd_pages():
    assert h.main_text('<div class="ad">x<article><p>Text here</p></article>') == "Text here"
    for odd in (None, "", "<", "<p", "<!--", "<a href='", "<script>", "</p></div>", '<div class="a" ' * 50):
        assert isinstance(h.main_text(odd), str)
    assert h.main_text("<article><p>a < b and 1<2</p></article>") == "a < b and 1<2"


def test_tree_fits_its_table():
    x, y = h.labelled()
    assert sum((h.decide(h.trained_tree(), row) >= 0.5) == bool(v) for row, v in zip(x, y)) >= 0.995 * len(y)


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "a"), (2, None, "<article>é ü</article>", "b"), (2, None, "<article>é ü</article>", "b")], "page_id long, url string, html string, text string")
    rows = sorted(map(tuple, h.extract(df).collect()), key=str)
    assert rows == [(1, "u", "", 0), (2, None, "é ü", 3), (2, None, "é ü", 3)]
    assert h.extract(df.limit(0)).count() == 0


def test_names_around_the_text_decide_nothing_alone():
    assert h.main_text(f'<div class="layout has-sidebar"><div class="content"><p>{LONG}</p><p>Short.</p></div></div>') == TEXT + " Short."
    assert h.main_text(f'<body class="with-sidebar menu-open"><div class="sidebar-left-layout"><div class="content"><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div></div>') == TEXT
    assert h.main_text(f'<div class="post"><div class="entry-header"><h1>My title</h1></div><p>{LONG}</p></div>') == "My title " + TEXT
    assert h.main_text(f"<article><header><h1>Title</h1></header><p>{LONG}</p><figure><figcaption>A caption.</figcaption></figure></article>") == f"Title {TEXT} A caption."


def test_comments_in_articles_of_their_own():
    assert h.main_text(f'<article><p>{LONG}</p></article><ol class="comment-list"><li><article><p>{LONG}</p></article></li></ol>') == TEXT


def test_inline_marks_and_quotes():
    assert h.main_text('<article><p>One <span class="ad">Buy it</span> two <span style="display: none">gone</span> three.</p><p hidden>no</p></article>') == "One two three."
    page = """<article><p title="x>One two three</p><p>Four <a title="a > b" href='x'>five</a></p></article><footer class="y">foot</footer>"""
    assert h.main_text(page) == "One two three Four five"


@pytest.mark.parametrize("part", ["<div>x", "</b>", "</div>x", "<span class=ad>x", "<p>x<b>", '<a "', "<p '", "<", "</", '"<"a', "<!--", '<div class="a" ', "<li><a>x"])
def test_time_grows_with_the_page(part):
    began = time.process_time()
    h.main_text(part * 100_000)
    assert time.process_time() - began < 10


class _Plain(HTMLParser):
    """Text of the article elements, with a space at each block tag."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attributes):
        self.inside += tag == "article"
        if tag not in h.INLINE or tag == "br":
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in h.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_pages_against_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in h.extract(pages).collect()}
    for row in pages.collect():
        plain = _Plain()
        plain.feed(row.html or "")
        plain.close()
        assert found[row.page_id] == " ".join("".join(plain.out).split())
