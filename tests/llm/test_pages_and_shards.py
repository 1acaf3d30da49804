"""Operators 1, 5, 7 and 10."""

import fnmatch
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import PAGES
from voxlake.llm import html_extraction, revisits, sharding, url_rules
from voxlake.llm.common import table
from voxlake.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<div id="content">{body}</div>
<aside class="sidebar"><p>Read this too, and that, and more of it, it goes on for a while and has commas, many of them, yes.</p></aside>
<div class="ad"><p>Buy now, buy here, buy everything, it is cheap, it is good, it is yours.</p></div>
<form><p>Your name, please</p><input name="q"></form><div id="comments"><p>First, I say, this is a comment of a reader, rather long, in fact.</p></div>
<footer>&copy; 2020</footer></body></html>"""


def test_main_text_keeps_the_article_and_nothing_else():
    body = "<h2>Head  line</h2><p>One &amp; two,\n three &lt;3 &#233;&nbsp;x.</p><p>Short <a href='/'>link</a>, <b>bold</b> text.<br>Next.</p><ul><li>First<li>Second</ul><p>Unclosed one<p>Unclosed two"
    want = "Head line\nOne & two, three <3 é x.\nShort link, bold text. Next.\nFirst\nSecond\nUnclosed one\nUnclosed two"
    assert html_extraction.main_text(PAGE.format(body=body)) == want


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("</div></p><p>x</b>", "x"), ("<script>x</script>", ""),
    ("<table><tr><td>1<td>2</table>", "1\n2"), ("<p>&bogus; &#x41;", "&bogus; A"), ("<article><header><h1>T</h1></header><p>b</p></article>", "T\nb"),
])
def test_main_text_of_small_and_broken_pages(html, text):
    assert html_extraction.main_text(html) == text


def test_main_text_of_very_deep_and_long_pages():
    assert html_extraction.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_extraction.main_text("<article>" + "<p>some words, again</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_extraction_of_every_page_agrees_with_its_article(spark, sf_dir):
    """The given pages hold one article each: its blocks, by a few substitutions."""
    from html import unescape

    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    rows = QUERIES["op1_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        found = re.search(r"<article>(.*?)</article>", pages[r.page_id] or "", re.DOTALL)
        if found:
            blocks = re.split(r"</?(?:p|h1|h2|div|ul|li|article)\b[^>]*>", re.sub(r"<!--.*?-->", "", found[1], flags=re.DOTALL))
            lines = [" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br ?/?>", " ", b))).split()) for b in blocks]
            assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text)


def test_extraction_on_edge_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'mine' AS text", "1 AS n_chars", "'k' AS kept")
    out = html_extraction.extract(pages)
    assert sorted(out.columns) == ["kept", "n_chars", "page_id", "text", "url"]
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("", 0), ("x", 1), ("x", 1)]
    assert html_extraction.extract(pages.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab*?.", max_size=9), min_size=1, max_size=30), st.lists(st.text("ab.c", max_size=12), min_size=1, max_size=8))
def test_automaton_agrees_with_globs(globs, texts):
    fits = url_rules.GlobAutomaton(globs).matches(texts)
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            assert fits[i, j] == bool(re.fullmatch(fnmatch.translate(glob), text))


def test_url_verdicts(spark):
    urls = {
        "http://a.example.com/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "https://EXAMPLE.COM/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "x://com/en/": ("com", "/en/", "com/en/", "block"), "http://notcom/en/": ("notcom", "/en/", None, "allow"), "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://b.net/de/8#f": ("b.net", "/de/8", "net/de/", "allow"), "http://o.org/es/?": ("o.org", "/es/", "org/es/", "block"), "http://o.org/ES/": ("o.org", "/ES/", None, "allow"),
        "http://spam-1.info/": ("spam-1.info", "/", None, "block"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://h?://x/en/": ("h", "", None, "allow"),
        None: ("", "", None, "allow"), "http://h\n.com/en/\n": ("h\n.com", "/en/\n", "com/en/", "block"),
    }
    rows = [(i, u, None) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS verdict", "3 AS rule", "4 AS GLOB", "5 AS `a.b`")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages).collect()}
    assert got == urls
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


RECORDS = "record_id string, url string, at long, kind string, status int, headers map<string,string>, body string"


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    etag = lambda v, **more: {"ETag": v, **more}
    rows = [
        ("r1", "http://www.a.org/x/", 10, "response", 200, etag('"1"', **{"Content-Length": "3", "X": "old"}), "one"),
        ("r2", "https://a.org/x#f", 20, "response", 200, etag('"2"', **{"Last-Modified": "d2"}), "two"), ("r3", "http://a.org/x", 25, "response", 500, etag('"9"'), "bad"),
        ("v1", "http://A.org:80/x", 15, "revisit", 304, etag('W/"1"', **{"Content-Length": "99", "x": "new"}), None), ("v2", "http://a.org/x?utm_source=1", 30, "revisit", 304, etag('"1"'), None),
        ("v3", "http://a.org/x", 20, "revisit", 304, {"etag": '"1"'}, None), ("v4", "http://a.org/x", 40, "revisit", 304, {"last-modified": "d2"}, None),
        ("v5", "http://a.org/x", 5, "revisit", 304, etag('"1"'), None), ("v6", "http://a.org/x", 50, "revisit", 304, None, None), ("v7", None, 50, "revisit", 304, etag('"1"'), None),
        ("v8", "http://a.org/x", None, "revisit", 304, etag('"1"'), None), ("v8", "http://a.org/x", None, "revisit", 304, etag('"1"'), None),
    ]
    records = spark.createDataFrame(rows, RECORDS).selectExpr("*", "'mine' AS found", "1 AS block", "2 AS stored")
    got = {r.record_id: r for r in revisits.resolve(records).collect()}
    assert {k: (r.response_id, r.resolution, r.body) for k, r in got.items()} == {
        "v1": ("r1", "resolved", "one"), "v2": ("r2", "mismatch", None), "v3": ("r1", "resolved", "one"), "v4": ("r2", "resolved", "two"), "v5": (None, "no_response", None),
        "v6": ("r2", "no_validator", None), "v7": (None, "no_response", None), "v8": (None, "no_response", None),
    }
    assert got["v1"].headers == {"etag": 'W/"1"', "content-length": "3", "x": "new"} and got["v2"].headers is None
    assert revisits.resolve(records.limit(0)).count() == 0


def test_revisits_find_a_response_many_blocks_back(spark):
    rows = [("old", "u.org/", 0, "response", 200, {"etag": "x"}, "b"), ("other", "v.org/", 5_000_000, "response", 200, {"etag": "y"}, "c")]
    rows += [(f"v{i}", "u.org", i * 1000 + 1, "revisit", 304, {"etag": "x"}, None) for i in range(3000)]
    found = revisits.resolve(spark.createDataFrame(rows, RECORDS))
    assert found.filter("resolution = 'resolved' AND response_id = 'old'").count() == 3000


def check_shards(rows, n_shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(n_shards)) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))


def test_shards_are_even_gapless_and_reproducible(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = sharding.assign_shards(docs, 8).collect()
    check_shards(rows, 8)
    again = sharding.assign_shards(docs.repartition(7), 8).collect()
    place = lambda rows: {r.doc_id: (r.shard, r.slot) for r in rows}
    assert place(rows) == place(again)
    n = len(rows)
    assert all(sharding.locate(r.row_number, n, 8) == (r.shard, r.slot) for r in rows)
    assert sorted(r.row_number for r in rows) == list(range(n))
    assert all(r.size == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode()) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 1021])
def test_the_network_is_a_permutation(n):
    keys = sharding.round_keys("seed")
    places = [sharding.locate(i, n, 1, "seed")[1] for i in range(n)]
    assert sorted(places) == list(range(n)) and sharding.longest_walk(n, keys) >= 1
    assert n < 20 or places != list(range(n))


def test_shards_of_hot_rows_and_edge_rows(spark, edge_docs, no_docs):
    hot = spark.range(3000).selectExpr("cast(if(id % 3 = 0, 5, id) AS long) AS doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) AS text")
    rows = sharding.assign_shards(hot, 8, most_equal=100).collect()
    check_shards(rows, 8)
    assert sorted(r.row_number for r in rows) == list(range(3000))
    edge = sharding.assign_shards(edge_docs, 5)
    check_shards(edge.collect(), 5)
    assert {r.doc_id: (r["size"], r.text_crc32) for r in edge.collect()}[1] == (1, 0)
    assert sharding.assign_shards(no_docs, 8).count() == 0
