from __future__ import annotations

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from caseflow.llm.html_text import extract_text, main_text

SF = "/root/testdata/sf0.01"
LONG = ["The river rose in the night, and by morning the lower fields were gone.", "Nobody had expected it so early; the dykes, they said, would hold until spring.", "In the town people carried chairs, lamps and books to the upper floors, and waited."]
SAID = "\n\n".join(LONG)
PARAS = "".join(f"<p>{p}</p>" for p in LONG)
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<html><head><title>t</title></head><body><header><h2>Site</h2></header><nav>{MENU}</nav><main><h1>Flood</h1>{PARAS}</main><footer>&copy; us. All rights reserved, for ever.</footer></body></html>", f"Flood\n\n{SAID}"),
        # an article with its own header, a figure, a list, a quotation and a table; comments and a sidebar around it
        (f'<body><div id="cookie-notice">We use cookies, really, many of them. Accept? Yes, please do.</div><article><header><h1>Flood</h1></header>{PARAS}<ul><li>one</li><li>two</ul><blockquote>They said: hold.</blockquote><table><tr><td>a<td>b</table></article>'
         f'<section id="comments"><article class="comment"><p>I was there, and it was worse, far worse, than they say. Believe me, all of you who read this.</p></article></section><aside>{PARAS}</aside></body>',
         f"Flood\n\n{SAID}\n\none\n\ntwo\n\nThey said: hold.\n\na\n\nb"),
        # no telling names at all: ratios decide
        (f'<body><div class="q1">{MENU}</div><div class="q2"><div class="q7">{PARAS}</div></div><div class="q3"><div>Imprint</div><div>Contact</div><div>Terms</div></div></body>', SAID),
        (f'<body><div class="q1"><span>Home</span></div><h1>Flood</h1>{PARAS}<h2>After</h2>{PARAS}<div class="q3">Imprint</div></body>', f"Flood\n\n{SAID}\n\nAfter\n\n{SAID}"),
        # text without paragraphs, line breaks inside a block
        (f'<table><tr><td class="l">{MENU}</td><td class="m">{"<br>".join(LONG)}</td></tr></table>', " ".join(LONG)),
        # a form that wraps the page stays, a form within it goes
        (f'<body><form id="f"><div class="sidebar">Read on: more, more, more. And more.</div><div class="content">{PARAS}</div><div class="newsletter"><input>Your address, please. We write rarely, if at all.</div></form></body>', SAID),
        (f'<body class="has-sidebar comments-open"><div class="post no-sidebar">{PARAS}</div><form action="/s"><label>Search</label><button>Go</button></form></body>', SAID),
        # an article in a main part with other things, related articles in a main part without one, headers within
        (f'<main><div class="hero">A quite long teaser, with commas, stops. And more of it, for show.</div><article><div class="entry-header"><h1>Flood</h1></div>{PARAS}<p class="ad">Buy, buy, buy. Now.</p></article></main>', f"Flood\n\n{SAID}"),
        (f'<div role="main">{PARAS}<ul class="related"><li><article><a href="/x">Other flood</a></article></li></ul></div><div class="page-header">Site, news. More.</div>', SAID),
        (f'<article><div class="elementor-widget"><p>{LONG[0]}</p></div><div class="elementor-widget"><p>{LONG[1]}</p></div><div class="elementor-widget"><p>{LONG[2]}</p></div><div class="widget">Weather: fine, mild. Dry.</div><div role="alert">Old browser, sorry.</div></article>', SAID),
        # tags in any state
        (f"<BODY><DIV CLASS=menu>{MENU}</DIV><ARTICLE><P><B>{LONG[0]}<P>{LONG[1]}</I><P title='a>b'>{LONG[2]}</ARTICLE><SCRIPT>if (a</b) {{ document.write('<p>no</p>') }}</SCRIPT>", SAID),
        (f'<article>{PARAS}<p hidden>secret</p><div style="display: none">secret</div><p aria-hidden="true">secret</p><span class="share-buttons"><span>Share</span> now</span><p>1 &lt; 2 &amp;&nbsp;3 &#8364; &#x41; &eacute;\n\t x</article>', f"{SAID}\n\n1 < 2 & 3 € A é x"),
        (f"<article>{PARAS}<p>cut <a href='x", f"{SAID}\n\ncut"),
        ("just words, no tags < at all", "just words, no tags < at all"),
        ("", ""), (None, ""), ("<nav>" + MENU + "</nav>", ""), ("<p></p>", ""), ("<!-- <p>no</p> -->", ""), ("<article><h1>Hm.</h1><p>Hm.</p></article><div>An unnamed and much longer text, that stands outside.</div>", "Hm.\n\nHm."),
    ],
)
def test_layouts(page, want):
    assert main_text(page) == want


def test_given_pages(spark):
    """The article of every given page, read by a rule that knows how these pages are made."""

    def known(page: str) -> str:
        article = page.split("<article>")[1].split("</article>")[0]
        return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>|<b>|<br>", article)) if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, known(r.html), len(known(r.html))) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert got == want


def test_rows_of_any_kind(spark):
    rows = [("a", "u", f"<article>{PARAS}</article>", 1), ("a", "u", f"<article>{PARAS}</article>", 2), (None, None, None, 3), ("b", "u", "", 4), ("c", "u", "<p>" + "word, " * 400_000 + "</p>", 5)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, n int").withColumn("n_chars", F.lit("clash")).withColumn("_text", F.lit(1))
    got = [tuple(r) for r in extract_text(df).collect()]
    assert got[0] == got[1] == ("a", "u", SAID, len(SAID)) and got[2] == (None, None, "", 0) and got[3] == ("b", "u", "", 0) and got[4][3] == 6 * 400_000 - 1
    assert extract_text(df.limit(0)).count() == 0


def test_time_is_linear_and_nothing_fails():
    rng = random.Random(1)
    for unit in ("<div>", "<a ", "<p>x", "<a b='", "<!--", "</p>", "<li>x", "<td>", "<script>", "<b><p></b>", "<form class=ad>", "&#x", "<a href=x>y", '<p class="', "<a =", "< "):
        for end in ("", ">", "'>"):
            began = time.perf_counter()
            main_text(unit * 40_000 + end)
            assert time.perf_counter() - began < 4, unit
    bits = ["<", ">", "</", "div", "p", "article", " ", '"', "'", "=", "text, more.", "<!--", "-->", "<script>", "&amp", "&#0;", "class=", "ad", "/>", "<td>", "<ul>", "<li>"]
    for _ in range(3000):
        main_text("".join(rng.choices(bits, k=30)))
