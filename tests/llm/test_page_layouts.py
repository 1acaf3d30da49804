"""Hand-made pages: ten layouts, each with six ways to name what isn't the article, and the article's text of each."""

import pytest

from voxlake.llm.html_extraction import main_text

P = [f"Paragraph {i} of the article says something, at some length, and it ends with a stop. It has a second sentence, too." for i in range(6)]
JUNK = "Words that nobody came for, in a row, with commas, and then some more of them, on and on."
LINKS = "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(6))
#: Names of reader comments, side column, adverts, menus, notices, lists of other pages.
STYLES = [
    dict(comments="comments", side="sidebar", ad="ad", nav="nav", notice="notice", other="related"),
    dict(comments="comment-list", side="left-sidebar", ad="ad-slot", nav="main-nav", notice="cookie-notice", other="related-posts"),
    dict(comments="comments-list", side="sidebar-left", ad="ad-container", nav="nav-main", notice="legal-notice", other="related-articles"),
    dict(comments="user-comments", side="page-sidebar", ad="google-ad", nav="navbar-top", notice="site-notice", other="related_stories"),
    dict(comments="post-comments", side="sidebar_right", ad="advert-box", nav="top-navigation", notice="cookie-consent", other="related-links"),
    dict(comments="comment-section", side="right-sidebar col-3", ad="sponsored-content", nav="mobile-menu", notice="newsletter-signup", other="related-news"),
]


def paragraphs(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


def comments(s, tag="div"):
    own = "".join(f"<{tag} class='comment-body'><b>Reader {i}</b><p>I read it, and I think otherwise, as {JUNK}</p></{tag}>" for i in range(5))
    return f"<section class='{s['comments']}'><h3>Comments</h3>{own}</section>"


def frame(s, inner, side=True):
    nav, foot = f"<div class='{s['nav']}'><ul>{LINKS}</ul></div>", "<footer>&copy; 2020, all rights reserved</footer>"
    aside = f"<div class='{s['side']}'><h3>Popular</h3><p>{JUNK}</p><ul>{LINKS}</ul></div>" if side else ""
    return f"<html><head><title>T</title></head><body>{nav}<div class='{s['notice']}'><p>{JUNK}</p></div>{inner}{aside}{foot}</body></html>"


def blog(s):
    ad = f"<div class='{s['ad']}'>{JUNK}</div>"
    return frame(s, f"<main><article><h1>Title</h1>{paragraphs(P[:3])}{ad}{paragraphs(P[3:])}{comments(s)}</article></main>"), ["Title", *P]


def forum(s):
    ad = f"<div class='{s['ad']}'><p>{JUNK}</p></div>"
    return frame(s, f"<div id='thread'><div class='post'><h1>Question</h1>{paragraphs(P)}</div>{ad}</div>{comments(s)}"), ["Question", *P]


def docs(s):
    body = f"<h1>Install</h1><p>{P[0]}</p><pre>make install</pre><ol><li>First, unpack it.</li><li>Then, run it.</li></ol>{paragraphs(P[1:4])}<table><tr><th>Flag</th><td class='search'>-s, for searching</td></tr></table>"
    return frame(s, f"<div class='content'>{body}</div>"), ["Install", P[0], "make install", "First, unpack it.", "Then, run it.", *P[1:4], "Flag", "-s, for searching"]


def news(s):
    teasers = "".join(f"<div class='teaser'><a href='/{i}'>Another story {i}</a></div>" for i in range(5))
    return frame(s, f"<div class='story'><h1>Headline</h1>{paragraphs(P)}</div><div class='{s['other']}'><h2>More</h2>{teasers}</div>"), ["Headline", *P]


def wiki(s):
    text = f"<p>{P[0]}</p><h2>History</h2><p>He owned a <span class='share'>large share</span> of it, and more.</p>{paragraphs(P[1:])}<ol><li>Smith, A., <a href='/b'>a book</a>, in two volumes, of some year.</li></ol>"
    return frame(s, f"<main><h1>Thing</h1>{text}</main>"), ["Thing", P[0], "History", "He owned a large share of it, and more.", *P[1:], "Smith, A., a book, in two volumes, of some year."]


def shop(s):
    return frame(s, f"<div class='product'><h1>Kettle</h1>{paragraphs(P[:4])}<ul><li>Holds two litres, or so.</li></ul></div><div class='{s['other']}'><ul>{LINKS}</ul></div>{comments(s)}"), ["Kettle", *P[:4], "Holds two litres, or so."]


def untagged(s):
    return frame(s, f"<div><div>{paragraphs(P)}</div></div>", side=False), P


def title_apart(s):
    return frame(s, f"<div class='head'><h1>Title apart</h1></div><div class='text'>{paragraphs(P)}</div>"), ["Title apart", *P]


def closing(s):
    return frame(s, f"<div id='all'><div>{paragraphs(P)}</div><div><p>A short closing section, in a part of its own, which is prose, and one line of eighty and more.</p></div></div>"), [
        *P, "A short closing section, in a part of its own, which is prose, and one line of eighty and more."]


def named_prose(s):
    inner = f"<h1>Named</h1><p class='related'>{P[0]}</p><p class='share'>{P[1]}</p>{paragraphs(P[2:])}<div class='{s['ad']}'>{JUNK}</div>"
    return frame(s, f"<article>{inner}</article>{comments(s, 'article')}"), ["Named", *P]


@pytest.mark.parametrize("style", range(len(STYLES)))
@pytest.mark.parametrize("layout", [blog, forum, docs, news, wiki, shop, untagged, title_apart, closing, named_prose], ids=lambda f: f.__name__)
def test_only_the_article_comes_out(layout, style):
    html, want = layout(STYLES[style])
    assert main_text(html).split("\n") == want


@pytest.mark.parametrize("mark", ["comment-list", "comments-area", "user-comment", "reader-comments"])
def test_comments_longer_than_the_article_go(mark):
    said = "".join(f"<div class='{mark}'><p>{JUNK} {i}</p></div>" for i in range(60))
    assert main_text(f"<body><article><h1>T</h1>{paragraphs(P)}{said}</article></body>").split("\n") == ["T", *P]


def test_labels_and_forms_are_no_text():
    assert main_text(f"<body><div>{paragraphs(P)}<label>Your name</label><form><p>Say {JUNK}</p></form></div></body>").split("\n") == P


def test_elements_named_as_widgets_keep_the_article():
    parts = "".join(f"<div class='elementor-widget widget-text'><p>{p}</p></div>" for p in P)
    assert main_text(f"<body><article>{parts}</article></body>").split("\n") == P
