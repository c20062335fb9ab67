"""Blocks of odd markup, whole pages, the tree against its table."""

import html
import re

import pytest

from tablelearn.llm import html_extract
from tablelearn.llm.html_blocks import blocks
from tablelearn.llm.queries import QUERIES
from tests.conftest import SF01


@pytest.fixture(scope="module")
def tree(spark):
    return html_extract.train(spark)


def test_tree_fits_its_table(tree):
    assert all(html_extract.classify(tree, r[:-1]) == r[-1] for r in html_extract.LABELLED)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no";</script>
<body><header><h1>Site</h1><p>The best site of all sites there are in this world, really.</p></header>
<nav><ul><li><a href=/a>One</a><li><a href="/b>c">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this long sentence even longer for you.</p></div>
<aside id=sideBar><p>A long text in a sidebar that nobody wants to read, with many many words.</p></aside>
<main><article><h1>Title &amp; more</h1><!-- <p>no</p> --><p>First   <b>bold</b>&nbsp;text<br>after &lt;br&gt;
<p>Un<i>bro</i>ken &#233;&#x2014;x</p><ul><li>item one<li>item <a href=x>two</a></ul>
<form><label>Name</label><input value="<p>"><textarea>no</textarea><button>Send now please</button></form>
<div class="ad-box">Buy this thing now, it is the best thing that you have ever bought.</div>
<p hidden>no</p><table><tr><td>cell a<td>cell b</table><blockquote>1 < 2 and 3 > 2</blockquote>
<section class="comments"><article><p>I liked this article very much, thank you for writing it.</p></article></section>
</article></main><footer>&copy; all rights reserved by the site's owners</footer></body></html>"""


def test_page(tree):
    assert html_extract.main_text(PAGE, tree).split("\n") == [
        "Title & more", "First bold text after <br>", "Unbroken é—x", "item one", "item two", "cell a",
        "cell b", "1 < 2 and 3 > 2"]


def test_page_without_article(tree):
    page = ("<div><a href=1>Home</a> <a href=2>News</a></div><div><h2>A heading</h2><div>" + "word " * 40
            + "</div><div>" + "text " * 30 + "</div><div><a href=3>Next page</a></div><div><a href=4>x</a></div></div>")
    assert html_extract.main_text(page, tree).split("\n") == [
        "A heading", ("word " * 40).strip(), ("text " * 30).strip()]


@pytest.mark.parametrize("cut", range(0, len(PAGE), 37))
def test_cut_pages_hold_no_markup(tree, cut):
    assert not re.search(r"</?(p|b|li|article)\b", html_extract.main_text(PAGE[:cut], tree).replace("<br>", ""))


@pytest.mark.parametrize("page, text", [
    ('<article><p title="the hidden valley">Kept <b data-x="my class=ad here">words</b>', "Kept words"),
    ("<article><p data-y='style=display:none hidden'>Kept</p><p hidden>no</p><p style='display : none'>no</p>", "Kept"),
    ('<article><div data-uri="' + "x" * 10_000 + '" data-x="<b>">Kept</div></article>', "Kept"),
    ('<article><p data-uri  =  "a > b" onclick=\'()=>f("x")\'>Kept', "Kept"),
    ('<main class="with-sidebar"><p>Kept</p></main>', "Kept"),
    ('<main><article class="post has-social"><p>Kept</p></article></main>', "Kept"),
    ('<article id="search-for-meaning"><p>Kept</p></article>', "Kept"),
    ('<div class="page has-sidebar"><article><p>Kept</p></article></div>', "Kept"),
    ('<article><header class="entry-header"><h1>Title</h1></header><p>Kept</p></article>', "Title\nKept"),
    ('<article><p>Kept</p><article class="comment-body"><p>no</p></article></article>', "Kept"),
    ('<article><p>Kept</p><div class="share-buttons"><p>no</p></div></article><article class="ad"><p>no', "Kept"),
])
def test_names_in_attributes(tree, page, text):
    assert html_extract.main_text(page, tree) == text


def test_linear_on_hostile_input(tree):
    for page in ("<div>x" * 30_000, "<div>" * 30_000 + "</x>" * 30_000, "<body>" * 30_000, "<a " + "b='c' " * 50_000 + ">",
                 "<a" + " " * 200_000 + "'" * 50_000,"<" * 200_000, "<!--" * 50_000, "<a href=\"" * 30_000, "<script>" * 20_000, "<p>x" * 20_000,
                 "<a '" * 30_000, "</" * 50_000, "&amp" * 50_000, "x" * 500_000, "<textarea>" * 10_000):
        html_extract.main_text(page, tree)
    assert [b.text for b in blocks("a<b>b</b>c<div>d")] == ["abc", "d"]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "u"), (None, "", None), (2, "<article>x</article>", "v"),
                                (2, "<article>x</article>", "v"), (3, "plain", "w")],
                               "page_id long, html string, HTML string")
    out = sorted(map(tuple, html_extract.extract(df).collect()), key=str)
    assert out == sorted([(1, ""), (None, ""), (2, "x"), (2, "x"), (3, "plain")], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_query(spark):
    """Every page's article, split by plain patterns that suit these pages only."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    rows = QUERIES["op1_html"](spark, SF01).collect()
    assert len(rows) == len(pages)
    for r in rows:
        m = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html or "", re.S)
        body = re.sub(r"<[^>]*$", "", m[1] if m else "")
        parts = [" ".join(html.unescape(re.sub("</?b>", "", p)).split())
                 for p in re.split("</?(?:h1|p)>|<br>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url
