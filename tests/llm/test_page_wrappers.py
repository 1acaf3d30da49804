"""Pages whose wrappers carry words of adverts and menus, and pages with a small article element beside a long body."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import html_extraction
from voxlake.llm.common import table

BODY = "".join(f"<p>Paragraph {i} of the text, which has some length, a comma or two, and no link at all.</p>" for i in range(8))
WANT = "\n".join(f"Paragraph {i} of the text, which has some length, a comma or two, and no link at all." for i in range(8))
TEASER = "<article><p>A teaser, short, of another page.</p></article>"


@pytest.mark.parametrize("mark", ["content has-sidebar", "no-ads", "search-results", "with-comments", "search", "banner", "comments", "sidebar"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_a_wrapper_around_the_text_does_not_discard_it(mark, tag):
    html = f"<body><nav><a href='/'>Home</a></nav><div class='{mark}'><{tag}>{BODY}</{tag}></div><footer>&copy; 2020</footer></body>"
    assert html_extraction.main_text(html) == WANT


@pytest.mark.parametrize("page", ["<div class='teasers'>{t}</div><div><div>{b}</div></div>", "<section><div>{b}</div></section><section>{t}</section>"])
def test_a_teaser_in_an_article_element_does_not_shut_out_the_body(page):
    assert html_extraction.main_text(f"<body>{page.format(t=TEASER, b=BODY)}</body>") == WANT


def test_marked_parts_beside_the_text_still_go():
    notice = "<p>Words of no use here, many of them, on and on, with commas, and more.</p>"
    parts = "".join(f"<div class='{mark}'>{notice}</div>" for mark in ("ad", "ads top", "cookie-notice", "sidebar", "widget2", "related"))
    html = f"<body><div id='page'>{parts}<article>{BODY}<div class='share'>{notice}</div></article><div id='comments'>{notice * 40}</div></div></body>"
    assert html_extraction.main_text(html) == WANT


def test_lists_and_parts_inside_the_article_stay():
    inner = (
        "<ul><li><a href='/1'>A first reference, by its authors, of some year</a></li><li><a href='/2'>A second one</a></li></ul>"
        "<div class='alert'>Mind this.</div><div class='related-work'>Others did that.</div><p>Then <math><mi>x</mi></math> and <object>an object's text</object>.</p>"
    )
    kept = "A first reference, by its authors, of some year\nA second one\nMind this.\nOthers did that.\nThen x and an object's text."
    assert html_extraction.main_text(f"<body><article>{BODY}{inner}</article></body>") == f"{WANT}\n{kept}"


def test_of_two_articles_beside_each_other_both_stay():
    assert html_extraction.main_text(f"<body><article>{BODY}</article><article>{BODY[: len(BODY) // 2]}</article></body>").count("Paragraph") == 12


def test_an_advert_longer_than_the_text_goes():
    advert = "<div class='ad'>Buy, buy, buy now, and buy more of it, it is cheap, it is good.</div>"
    assert html_extraction.main_text(f"<body>{advert}<div><h1>Short.</h1><p>It is.</p></div></body>") == "Short.\nIt is."


def test_the_score_alone_finds_the_text_of_every_page(spark, sf_dir):
    """The given pages with their article elements renamed."""
    for r in table(spark, sf_dir, "pages").collect():
        plain = re.sub(r"<(/?)article>", r"<\1div>", r.html or "")
        assert html_extraction.main_text(plain) == html_extraction.main_text(r.html)


@pytest.mark.parametrize(("html", "text"), [
    ("<![foo [x]]><p>a</p>", "a"), ("a<!--", "a"), ("x<a href=", "x"), ("x<a href=\"y>z", "x"), ("x<!DOCTYPE", "x"), ("x<?php x", "x"), ("<![CDATA[y]]>x", "x"),
    ("1 < 2, 3<4 <3 you <", "1 < 2, 3<4 <3 you <"), ("</>a</ >b", "ab"), ("<!---->x<!-->y", "xy"), ("<a title=it's>x</a>", "x"), ("<p>x<svg/>y</p>", "xy"), ("a<p/>b", "a\nb"),
])
def test_markup_never_comes_out(html, text):
    assert html_extraction.main_text(html) == text


PIECES = ["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<ul>", "<li>", "<table>", "<td>", "<!--", "-->", "<![", "]]>", "<?", "<!", "</", "<a href=\"", "'", ">", "<script>", "</script>", "<title>", "&", "&#", "&#xD800;", "&lt", "x, y", " ", "\x00", "é", "<svg/>", "<p hidden>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=5)), max_size=40).map("".join))
def test_no_page_breaks_the_reader(html):
    text = html_extraction.main_text(html)
    assert text.encode("utf-8", "surrogatepass") is not None and all(line == line.strip() and line for line in text.split("\n")) or text == ""


def test_work_does_not_grow_with_depth():
    def seconds(n):
        began = time.perf_counter()
        html_extraction.main_text("<div><p>some words, here and there</p>" * n + "</i></p>" * n)
        return time.perf_counter() - began

    assert seconds(16_000) < 8 * max(0.1, min(seconds(4_000), seconds(4_000)))
