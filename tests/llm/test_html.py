from __future__ import annotations

import pytest

from quillon.llm.html import extract, main_text, parse

PARAGRAPH = "This paragraph has quite a few words, so that it is long enough to be dense."

CASES = {
    "marked article": (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>a</a></li></ul></nav><!-- ad --><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p><b>{PARAGRAPH}<br><p>Second&nbsp; one\n here.</p></article><footer>&copy; x</footer></body></html>",
        ["A & B", PARAGRAPH, "Second one here."],
    ),
    "no semantic tags": (
        f"<body><div id=nav><a href=1>One</a><a href=2>Two</a></div><div id=c><h1>Title here</h1><div><p>{PARAGRAPH}</p><p>{PARAGRAPH} Again.</p></div><div><p>{PARAGRAPH} More.</p></div><div class=post-footer><a href=4>previous</a> <a href=5>next</a></div></div><div class=foot><small>(c) 2020 Some Corp.</small></div>",
        ["Title here", PARAGRAPH, PARAGRAPH + " Again.", PARAGRAPH + " More."],
    ),
    "parts inside the article": (
        f"<div class='with-sidebar'><div class=header><a href=/>Home</a></div><article><header><h1>T</h1></header><section><p>{PARAGRAPH}</p><div class='ad-box'>Buy!</div></section><ul class=share><li><a href=1>x</a><li><a href=2>y</a></ul><form>name <input></form><div id=comments><article class=comment>hi</article></div></article><aside>side</aside></div><div class=cookie-notice>We use cookies</div>",
        ["T", PARAGRAPH],
    ),
    "heading before the content": (f"<body><div class=site-header>Site name</div><h1 class=post-header>Head</h1><div id=content><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div id=leftSidebar><p>{PARAGRAPH}</p></div>", ["Head", PARAGRAPH, PARAGRAPH]),
    "long comments": (f"<body><div class=post><p>{PARAGRAPH}</p></div><div id='comment-list'>" + f"<p>{PARAGRAPH} I disagree.</p>" * 9 + "</div>", [PARAGRAPH]),
    "a name around the article": (f"<body><nav>x</nav><div class='search-page'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div class=notice>Read our rules.</div></div>", [PARAGRAPH, PARAGRAPH]),
    "line breaks": (f"<div id=main-text>{PARAGRAPH}<br><br>{PARAGRAPH}<br/>End.</div><div class=footer>f</div>", [PARAGRAPH, PARAGRAPH, "End."]),
    "quotes and code": (f"<main><blockquote>{PARAGRAPH}</blockquote><pre>a\n  b</pre><figure><img alt=x><figcaption>Caption</figcaption></figure><button>Go</button></main>", [PARAGRAPH, "a b", "Caption"]),
    "lists and tables": ("<article><p>a<p>b<ul><li>x<li>y</ul>c<table><tr><td>1<td>2<tr><td>3</table></article>", ["a", "b", "x", "y", "c", "1", "2", "3"]),
    "plain": ("plain &lt;text&gt; only\n here", ["plain <text> only here"]),
    "broken": ("<p>one < two <b>three</p><p>four", ["one < two three", "four"]),
    "cut off": ("<article><p>first</p><p>second &am", ["first", "second &am"]),
    "empty": ("", []),
    "null": (None, []),
    "nothing but menus": ("<nav>menu</nav>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_extract(name):
    page, lines = CASES[name]
    assert extract(page) == "\n".join(lines)


def test_deep_and_long():
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert extract(deep) == "core"
    long = "<article>" + "<p>word " * 20000 + "</article>"
    assert extract(long).count("\n") == 19999
    assert parse("</p></div>").children


def test_main_text(spark):
    rows = [(1, "u", CASES["plain"][0], 5), (2, None, None, 6), (1, "u", CASES["plain"][0], 5), (None, "v", "<p>é</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "plain <text> only here", 22)] * 2 + [(2, None, "", 0), (None, "v", "é", 1)], key=str)
    assert main_text(pages.limit(0)).collect() == []


def test_named_blocks_and_odd_tags_take_linear_time():
    import time

    began = time.perf_counter()
    assert extract("<div class='related'>x y z</div>" * 100_000 + f"<div id=c><p>{PARAGRAPH}</p></div>").endswith(PARAGRAPH)
    extract("<b>" * 20_000 + "</i>" * 20_000)
    extract("<p class=\"x>hello " * 20_000)
    assert time.perf_counter() - began < 30


MARKUP = {
    "a quote left open lasts to the page's end": ("<p>one</p><p class=\"x>two", "one"),
    "quotes inside a value or a name are no quotes": ("<p title=it's>one</p><p \"x>it's</p>", "one\nit's"),
    "values with a greater sign": ("<p title='a > b'>one</p>", "one"),
    "comments": ("<p>a<!-->b<!-- x --!>c</ d>e</>f</p>", "abcef"),
}


@pytest.mark.parametrize("name", MARKUP)
def test_markup_as_the_standard_reads_it(name):
    page, text = MARKUP[name]
    assert extract(page) == text


def test_links_in_running_text_stay():
    line = "See <a href=1>alpha beta</a>, <a href=2>gamma delta</a>, <a href=3>epsilon zeta</a>"
    plain = "See alpha beta, gamma delta, epsilon zeta"
    assert extract(f"<article><p>{PARAGRAPH}</p><p>{line}</p><div><p>{line}</p></div><ul><li><a href=1>alpha</a><li><a href=2>beta</a></ul></article>") == "\n".join([PARAGRAPH, plain, plain])


def test_sections_named_like_comments():
    section = f"<section class=discussion><h2>Discussion</h2><p>{PARAGRAPH}</p></section>"
    talk = "<section class=discussion><div class=comment-body><p>I agree.</p></div></section><div id=responses><form><p>Say something</p></form></div>"
    assert extract(f"<article><p>{PARAGRAPH}</p>{section}{talk}</article>") == "\n".join([PARAGRAPH, "Discussion", PARAGRAPH])


def test_pages_without_semantic_elements():
    """An independent check: the article's lines are known, and wrapped in menus and adverts."""
    import random

    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice("river stone light under walking bread sudden evening colour thirty".split()) for _ in range(rng.randrange(12, 60))).capitalize() + "."
    for k in range(60):
        lines = [sentence() for _ in range(rng.randrange(3, 12))]
        menu = "<ul>" + "".join(f"<li><a href=/{i}>{rng.choice(['Home', 'News', 'Contact us', 'Archive'])}</a></li>" for i in range(rng.randrange(3, 15))) + "</ul>"
        tag = rng.choice(["p", "div"])
        body = "".join(f"<{tag}>{x}</{tag}>" for x in lines)
        page = f"<html><head><title>t</title></head><body><div class=top>{menu}</div><div><div class=ad>Buy now!</div><div id=w{k}>{body}</div></div><div class=sidebar>{menu}</div><div class=footer>{sentence()}</div></body></html>"
        assert extract(page) == "\n".join(lines), page
