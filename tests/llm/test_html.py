from __future__ import annotations

import itertools
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumenfold.llm import html_extract as hx

MODEL = hx.train()


def truth(html):
    page = hx.parse(html)
    return "\n".join(text for k, text, _ in page.runs if page.marked[k])


def test_held_out_pages():
    pages = [hx.write_page(10**9 + k) for k in range(200)]
    same = sum(hx.extract(p, MODEL) == truth(p) for p in pages)
    assert same >= 165


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">home</a></li><li><a href="/b">about</a></li><li><a href="/c">news</a></li></ul></nav><!-- x --><div class="ad">Buy this now.</div>
<article><h1>A title of some words</h1><p><b>First   paragraph &amp; words of it, long enough to be one.<br><p>Second\tparagraph with a
line break, &eacute;t&eacute; and &lt;tags&gt;, followed by more words.</p></article><footer>&copy; site &middot; all rights</footer>"""


@pytest.mark.parametrize("end", ["</body></html>", ""])
def test_page(end):
    assert hx.extract(PAGE + end, MODEL) == "A title of some words\nFirst paragraph & words of it, long enough to be one.\nSecond paragraph with a line break, été and <tags>, followed by more words."


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "</div></p>", "<script>x", "<b><i></b></i>", "<table><tr><td>a<td>b<tr><td>c"])
def test_broken_pages_dont_crash(html):
    assert isinstance(hx.extract(html, MODEL), str)
    if not html or not html.strip():
        assert hx.extract(html, MODEL) == ""


def test_blocks():
    page = hx.parse("<div>one <b>two</b><p>three<p>four</div>five<ul><li>a<li>b</ul><script>no</script><br>six")
    assert [t for _, t, _ in page.runs] == ["one two", "three", "four", "five", "a", "b", "six"]


HOSTILE = {
    "unclosed lists": "<ul>" * 250_000,
    "tags that never end": "<a " * 350_000,
    "open formatting, then items": "<b>" * 150_000 + "<li>" * 100_000,
    "formatting closed from below": "<b>" * 100_000 + "<i></b>" * 100_000,
    "stray ends in open formatting": "<i>" * 150_000 + "</b>" * 150_000,
    "a paragraph far outside": "<p><td>" + "<foo>" * 60_000 + "<ul></ul>" * 60_000,
    "hidden elements and stray ends": "<option>" * 60_000 + "</x>" * 100_000,
    "unclosed quotes": "<a b='\">" * 150_000,
    "unclosed comments": "<!--" * 250_000,
    "ends without a name": "</" * 500_000,
    "an endless reference": "&" * 500_000 + "&#" + "9" * 500_000 + ";",
    "endless blanks in a tag": "<a" + " " * 1_000_000,
    "repeated bodies": "<body>" * 160_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_bad_markup_takes_seconds(name):
    began = time.time()
    page = hx.parse(HOSTILE[name])
    hx.decode(page, MODEL.log_odds(hx.node_features(page)))
    assert time.time() - began < 12


@pytest.mark.parametrize(
    ("html", "events"),
    [
        ("a < b<p class=x ID='y' data-z>c</P>d", [("text", "a < b", []), ("start", "p", [("class", "x"), ("id", "y"), ("data-z", "")]), ("text", "c", []), ("end", "p", []), ("text", "d", [])]),
        ('<a href="x>y">&amp;&#65;&#x42;&#99999999;</a>', [("start", "a", [("href", "x>y")]), ("text", "&AB\ufffd", []), ("end", "a", [])]),
        ("<!-- <p> -->x<!-->y<!doctype html>z<?pi?>", [("text", "x", []), ("text", "y", []), ("text", "z", [])]),
        ("<script>a<b</p></script >t<br/>u", [("start", "script", []), ("text", "a<b</p>", []), ("end", "script", []), ("text", "t", []), ("empty", "br", []), ("text", "u", [])]),
        ("x<p", [("text", "x", [])]),
        ("x<a b='c", [("text", "x", [])]),
        ("1 <2 <é", [("text", "1 <2 <é", [])]),
    ],
)
def test_scanning(html, events):
    assert list(hx.scan(html)) == events


def test_decoding_is_the_likeliest_consistent_choice():
    rng = np.random.default_rng(1)
    for _ in range(60):
        page = hx.parse("<div>a<p>b</p><section><p>c</p></section></div><div><p>d</p></div>")
        n = len(page.tag)
        s = rng.normal(size=n)
        holds = {k for k, *_ in page.runs}

        def fits(keep):
            up = all(page.parent[k] < 0 or keep[page.parent[k]] for k in range(n) if keep[k])
            return up and all(k in holds or any(keep[j] and page.parent[j] == k for j in range(n)) for k in range(n) if keep[k])

        best = max((x for x in itertools.product((False, True), repeat=n) if fits(x)), key=lambda x: sum(s[k] for k in range(n) if x[k]))
        assert sum(s[hx.decode(page, s)]) == pytest.approx(sum(s[k] for k in range(n) if best[k]))
        assert fits(hx.decode(page, s))


def test_boosting_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    m = hx.boost(x[:1500], y[:1500])
    assert ((m.log_odds(x[1500:]) > 0) == (y[1500:] > 0.5)).mean() > 0.95


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "<article><p>" + "word " * 100_000 + "</p></article>", "x")]
    got = hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and len({r.text for r in got if r.page_id == 1}) == 1
    assert [(r.text, r.n_chars, r.url) for r in got if r.page_id is None] == [("", 0, None)]
    assert [r.n_chars for r in got if r.page_id == 2] == [499_999]
    assert hx.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Events(HTMLParser):
    """The standard parser's events, neighbouring texts joined."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.events = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, [(n, v or "") for n, v in attrs]))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("empty", tag, [(n, v or "") for n, v in attrs]))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, []))

    def handle_data(self, data):
        if self.events and self.events[-1][0] == "text":
            data = self.events.pop()[1] + data
        self.events.append(("text", data, []))


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01/pages.parquet", None])
def test_scanning_like_the_standard_parser(table):
    pages = pq.read_table(table).column("html").to_pylist() if table else [hx.write_page(7 * 10**6 + k) for k in range(300)]
    for html in filter(None, pages):
        assert [x for x in hx.scan(html) if x[1]] == Events(html).events
