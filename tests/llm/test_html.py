"""Page frames, names and clashing columns of the HTML blocks."""

import pytest

from chunkgraph.llm import op06_html_blocks as html_blocks

ARTICLE = "<article><h1>A title of words</h1><p>" + "word " * 60 + ".</p><p>" + "again " * 40 + ".</p></article>"
PAGE = '<nav><a href="x">Home</a> <a href="y">News</a></nav>' + ARTICLE + '<div class="related-posts"><p>Other words stand here.</p></div><footer>Some words below</footer>'
WANT = "\n".join(["A title of words", ("word " * 60 + ".").strip(), ("again " * 40 + ".").strip()])
TREE = html_blocks.train()
FRAMES = [
    "%s", '<div class="site has-sidebar">%s</div>', '<div id="page" class="no-sidebar">%s</div>', '<div class="header-fixed">%s</div>', '<div class="search-results content">%s</div>',
    '<div class="page-with-menu">%s</div>', '<form id="aspnetForm">%s</form>', '<div class="modal-open"><form><div id="menu">%s</div></form></div>',
]


@pytest.mark.parametrize("frame", FRAMES)
def test_a_frame_of_the_page_is_nothing_beside_the_article(frame):
    assert html_blocks.main_text(frame % PAGE, TREE) == WANT


@pytest.mark.parametrize("aside", ['<div class="comments">%s</div>', "<aside>%s</aside>", '<section id="comment-list">%s</section>', '<div class="siteFooter">%s</div>'])
def test_what_stands_beside_stays_out_however_long(aside):
    long = aside % ("<p>" + "talk " * 400 + ".</p>")
    assert html_blocks.main_text(f'<div class="has-sidebar">{PAGE}{long}</div>', TREE) == WANT


def test_names_are_compounds():
    assert set(html_blocks.named("text-ad-free")) == {"text", "free"}
    assert set(html_blocks.named("mainNav no-sidebar ad_slot has-menu-open")) == {"main", "nav", "ad", "slot"}
    page = f'<div class="text-ad-free"><p>{"word " * 50}.</p></div>'
    assert html_blocks.main_text(page, TREE) == ("word " * 50 + ".").strip()


def test_the_tree_is_no_rule_of_tags():
    """Within one article: a list of sources stays, a menu goes; blocks without any article are told by their words."""
    text = "<p>" + "word " * 50 + ".</p>"
    sources = "".join(f"<li><a href='s'>{'source ' * 9}</a>" for _ in range(3))
    menu = "".join(f"<li><a href='m'>{x}</a>" for x in ("Home", "About us", "More"))
    found = html_blocks.main_text(f"<article><h1>Title</h1>{text}<ul>{menu}</ul>{text}<ul>{sources}</ul></article>", TREE)
    assert [line.split()[0] for line in found.split("\n")] == ["Title", "word", "word", "source", "source", "source"]
    bare = html_blocks.main_text(f"<div>{menu}</div><div>{text}{text}</div><div>{menu}</div>", TREE)
    assert [line.split()[0] for line in bare.split("\n")] == ["word", "word"]


def test_marks_are_told_in_linear_time():
    import time

    began = time.time()
    html_blocks.main_text("<form class=menu>" * 60_000 + "<p>word" * 60_000, TREE)
    assert time.time() - began < 20


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x", 7), (2, None, None, "y", 8), (None, "u", "", None, None)], "page_id long, url string, html string, text string, n_chars int")
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in html_blocks.extract(rows).collect()}
    assert found == {1: ("u", WANT, len(WANT)), 2: (None, "", 0), None: ("u", "", 0)}
