"""Main text of pages with long comments, of damaged pages, and of pages without content of their own."""

import time

import pytest

from tickweave.llm import html_extract

WEIGHT = html_extract.weights({}, {})
ARTICLE, NOISE = "word " * 120, "noise " * 500


@pytest.mark.parametrize(
    "around",
    [
        '<article><p>{a}</p></article><div class="comments"><p>{n}</p></div>', '<article><p>{a}</p></article><section id="comments"><p>{n}</p></section>', '<article><p>{a}</p><div class="comments"><p>{n}</p></div></article>',
        '<article><p>{a}</p></article><div class="cookie-notice"><p>{n}</p></div>', '<article><p>{a}</p></article><div class="sidebar"><p>{n}</p></div>', '<article><p>{a}</p></article><div id="discussion"><p>{n}</p></div>',
        '<div><p>{a}</p></div><div class="comments"><p>{n}</p></div>', '<div><p>{a}</p></div><section id="reader-comments"><article><p>{n}</p></article></section>', '<main><p>{a}</p></main><form class="comment-form"><p>{n}</p></form>',
        '<article><p>{a}</p></article><form><p>{n}</p></form>', '<form><article><p>{a}</p></article><div class="comments"><p>{n}</p></div></form>', '<article><p>{a}</p></article><aside><article><p>{n}</p></article></aside>',
    ],
)
def test_left_out_elements_longer_than_the_article(around):
    page = f"<html><body><nav><a>Home</a></nav>{around.format(a=ARTICLE, n=NOISE)}<footer>end</footer></body></html>"
    assert html_extract.main_text(page, WEIGHT) == ARTICLE.strip()


@pytest.mark.parametrize("around", ['<div class="sidebar"><p>{a}</p></div>', '<div class="notice">{a}</div>', "<form><p>{a}</p></form>", "<aside><p>{a}</p></aside>", '<nav><a>Home</a></nav><div class="widget"><p>{a}</p></div><div class="comments">{n}</div>'])
def test_a_page_whose_only_content_is_left_out_keeps_it(around):
    assert html_extract.main_text(f"<body>{around.format(a=ARTICLE, n=NOISE)}</body>", WEIGHT) == ARTICLE.strip()


def test_comments_alone_give_no_text():
    assert html_extract.main_text(f'<body><div class="comments">{NOISE}</div></body>', WEIGHT) == ""


def test_a_long_list_inside_an_article_does_not_part_it():
    page = f"<body><article><p>{ARTICLE}</p>{'<a href=x></a>' * 300}<p>{ARTICLE}</p></article></body>"
    assert html_extract.main_text(page, WEIGHT).count("word") == 240


@pytest.mark.parametrize(
    "unit", ["<svg ", '<a "', "<a '", "<div>", "<p>", "<li>", "<td>x", "</div>", "<a \">\" <b '", "<![CDATA[", "<!--", "<!x ", "<?", "<", "<script>", "</script ", "<a x=\"<\" y='", "class = ", "<div class=" + " " * 50, "<nav>", "<article>", "<form>", "<ul><li>", "<table><tr><td>", '<div class="comments">', "&amp;", "<b", "</"]
)
def test_damaged_pages_of_a_megabyte(unit):
    page = unit * (1_000_000 // len(unit))
    for whole in (page, f"<p>{ARTICLE}</p>{page}", page + "'", page + ">"):
        began = time.process_time()
        html_extract.main_text(whole, WEIGHT)
        assert time.process_time() - began < 6  # a second or two each; quadratic reading takes hours


def test_tag_ends():
    seen = lambda page: [(k, v) for k, v, _ in html_extract.tokens(page)]
    assert seen("a<b x='>'>c</b>") == [("text", "a"), ("open", "b"), ("text", "c"), ("close", "b")]
    assert seen("a<b x=\"<i>\">c") == [("text", "a"), ("open", "b"), ("text", "c")]
    assert seen("a<b x='>c") == [("text", "a"), ("open", "b"), ("text", "c")]
    assert seen("1 < 2 <3> <b") == [("text", "1 < 2 <3> <b")]
    assert seen("x<!-- <b> -->y<svg><b></svg>z<svg/>w<!-- open") == [("text", "x"), ("text", "y"), ("text", "z"), ("open", "svg"), ("text", "w")]
    assert seen("<SCRIPT>if (a<b) {}</Script >t<style>u") == [("text", "t")]
