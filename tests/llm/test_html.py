"""Main text of pages."""

from __future__ import annotations

import html as references
import re
import time

import pytest

from wearline.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body>
<header class="site-header"><h1>Site name</h1><form><input><label>Search here</label></form></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">About us</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
{main}
<aside>Other things to read in the sidebar, quite long as such things often are.</aside><div class="ad banner">Buy this now, it is really cheap.</div>
<section id="comments"><article class="comment"><p>A reader says a long thing about this page that is no part of it.</p></article></section>
<footer>&copy; 2024 Site name, all rights reserved.</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p><b>Unclosed bold.<br>Next&nbsp;line<p>Short.</p>  \n<p>A longer\n paragraph with <a href=x>a link</a> &lt;b&gt; in it.</p><ul><li>One<li>Two</ul><div class='share'>Share this!</div>"
TEXT = "Title & more\nUnclosed bold. Next line\nShort.\nA longer paragraph with a link <b> in it.\nOne\nTwo"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div role='main'>{}</div>", "<div class=\"widget\"><article>{}</article></div>"])
def test_article_without_its_surroundings(wrap):
    assert html.main_text(PAGE.replace("{main}", wrap.format(BODY))) == TEXT


def test_page_without_article_by_density():
    long = "<p>This is a paragraph that is long enough to be taken for text of a page by its length.</p>"
    page = PAGE.replace("{main}", f"<div><h2>Head</h2>{long * 3}<p>End.</p></div>")
    found = html.main_text(page)
    assert found.startswith("Head\nThis is") and found.endswith("End.") and "cookies" not in found and "reader" not in found and "Home" not in found


def test_odd_input():
    assert html.main_text("") == "" and html.main_text("plain text") == "plain text"
    assert html.main_text("<p>a<!-- never closed <p>b") == "a"
    assert html.main_text("<article><p>a < b and 3 > 2</p><script>x") == "a < b and 3 > 2"
    assert html.main_text("<nav>only a menu</nav>") == ""
    assert html.main_text("</div></p><article><p>x</article></article></b><p>after") == "x"


def test_classes_of_the_page_hide_nothing():
    for wrap in ("<div class='page has-sidebar'>{}</div>", "<div id='widget-area'><article>{}</article></div>", "<div class='no-comments'><main class='menu'>{}</main></div>"):
        assert html.main_text(f"<body class='no-comments with-sidebar'>{wrap.replace('{}', BODY)}</body>") == TEXT
    inside = BODY + "<div class='related teaser'><p>Read this too, it is long enough to be text.</p></div><div id='disqus_thread'><article><p>A reader's article.</p></article></div>"
    assert html.main_text(f"<article>{inside}</article><div class='comment-list'><article><p>More of readers.</p></article></div>") == TEXT


def test_surge_and_dive():
    assert html.regions([0, 5, 50, 60, 0, 2, 0, 0, 0, 9, 0, 0, 0], 80) == [(1, 6)]
    assert html.regions([1, 0, 0, 0, 1], 1) == [(0, 1), (4, 5)]
    assert html.regions([], 1) == []


def test_query_against_the_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html.op2_html_extraction(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = re.sub(r"</?(?:p|h\d)>", "\x01", re.sub(r"<br>|</?b>", " ", inner)).split("\x01")
        expected = "\n".join(b for b in (" ".join(references.unescape(x).split()) for x in blocks) if b)
        assert r["text"] == expected and r["n_chars"] == len(expected)


def test_table_cases(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article>x</article>"), (2, "u", "<article>" + "<p>word</p>" * 30_000 + "</article>")]
    own = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {(r["page_id"], r["html"] is None): r["text"] for r in html.extract(own).collect()}
    assert found[None, False] == "x" and found[1, True] == found[1, False] == "" and found[2, False] == "\n".join(["word"] * 30_000)
    assert html.extract(own.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["div", "section"])
def test_pages_without_article_element(sf, name, spark):
    """The curve finds the same text where nothing but weights can tell."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        renamed = re.sub(r"(</?)article>", rf"\1{name}>", r["html"])
        assert html.main_text(renamed) == html.main_text(r["html"]), r["page_id"]


@pytest.mark.parametrize("tag", ['<p style="overflow:hidden">', '<p aria-hidden="false">', '<p data-role="dialog">', '<p title="no hidden fees">', '<section id="social-contract">', '<p class="search-history">', '<h2 id="related-work">', '<p id="comments">'])
def test_attributes_are_read_as_attributes(tag):
    name = re.match(r"<(\w+)", tag)[1]
    assert html.main_text(f"<article>{tag}Some text of the article.</{name}><p>More.</p></article>") == "Some text of the article.\nMore."


def test_what_names_a_side_part_inside_an_article():
    for tag in ('<div class="related-posts">', '<div id="share-buttons">', '<div hidden>', '<div role="dialog">', '<div class="comment-list">'):
        assert html.main_text(f"<article><p>Text here.</p>{tag}<p>Not this, though it is long enough.</p></div></article>") == "Text here."


@pytest.mark.parametrize("unit", ["<p ", "<p '", '<p "<p \'', "<!--", "<script>", "<a href=x", "<", "<p>x", "<!", "</", "<div>", "</div>", "<p class='a b'>"])
def test_time_follows_length(unit):
    def seconds(n):
        page = unit * (n // len(unit))
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    small, large = min(seconds(250_000) for _ in range(2)), min(seconds(1_000_000) for _ in range(2))
    assert large < max(0.5, 8 * small) and large < 6
