"""Main text of pages: marked-up cases, and the test tables against their article elements."""

import html as html_
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobsignal.llm import main_text, queries

LONG = "The committee met on Tuesday, and after a long debate, it agreed to publish the report."
CASES = {
    "boilerplate by class, heading beside the container": (
        f"<div id=wrap><div class='site-header'><a href=/>Home</a></div><h1>Title</h1><div class=content><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div></div>",
        f"Title\n{LONG}\n{LONG}",
    ),
    "inside an article": (
        "<article><header><p>By me</p><h1>T</h1></header><p>a <span class=ad>BUY</span> b</p><ul><li><a>x1</a><li><a>x2</a><li><a>x3</a></ul><form><p>mail</p></form><aside>more</aside><p>c&nbsp;&lt;d&gt; 1 < 2</article>",
        "T\na b\nc <d> 1 < 2",
    ),
    "a form around everything": ("<form><main><p>in a form</p></main></form>", "in a form"),
    "implied end tags, breaks": ("<p>one<p>two<br>three<div>four</div>", "one\ntwo three\nfour"),
    "scripts, styles, comments": ("<script>if(a<b){}</script><style>x</style><!-- <p>no</p> --><article>t<i>e</i>xt<script>never closed <p>x", "text"),
    "tables and lists": ("<table><tr><td>A<td>B<tr><td>C</table>", "A\nB\nC"),
    "two parts side by side": (f"<div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG} More.</p></div><div><a href=x>a</a> <a href=y>b</a></div></div>", f"{LONG}\n{LONG}\n{LONG} More."),
    "an article without text": ("<nav>x</nav><div class='ad'>y, z, and a long advert text that never ends, really</div><article></article><footer>f</footer>", ""),
    "comments as articles": (f"<article><p>{LONG}</p></article><section id=comments><article><p>{LONG} Says who?</p></article></section>", LONG),
    "names that say the opposite": (f"<body class='has-sidebar no-comments'><div class='content with-sidebar'><p>{LONG}</p></div></body>", LONG),
    "cookie notice and newsletter": (f"<div class='cookie-consent'><p>{LONG}</p></div><main><p>{LONG}</p><div class=newsletterSignup>{LONG}</div></main>", LONG),
    "references": ("<article><p>Caf&eacute; &#x41;&#66; &amp;amp; &notanentity; &copy 1</p></article>", "Café AB &amp; ¬anentity; © 1"),
    "no markup": ("plain  text\nonly", "plain text only"),
    "empty": ("", ""),
    "null": (None, ""),
    "cut short": ("<article><p>whole</p><p cla", "whole"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert main_text.page_text(page) == want


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<table>", "<td>", "<li>", "<ul>", "</ul>", "<span class=ad>", "</span>", "<nav>", "</nav>", "word, ", "&amp;", "<", ">", "<!--", "-->", "<a href=x>", "</a>", "<script>", "</script>", "\n"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_markup(parts):
    out = main_text.page_text("".join(parts))
    assert out == "\n".join(" ".join(x.split()) for x in out.split("\n")) and "\n\n" not in out


def test_long_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 100_000 + "x" + "</section>" * 100_000, '<a href="x>' * 50_001, "<script>" * 50_000, "<!--" * 100_000, "<p " * 100_000, "<" * 300_000, "<table><td>" * 30_000 + "</div>" * 30_000):
        main_text.page_text(page)
    assert time.time() - began < 60


def test_odd_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "t", 1), (1, "u", "<article><p>a</p></article>", "t", 1), (None, None, None, None, None), (2, "u", "", "t", 2), (3, "u", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>", "t", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _text string, _n_chars int")
    got = sorted((tuple(r) for r in main_text.main_text(pages).collect()), key=str)
    texts = ["a", "a", "", "", "\n".join([LONG] * 5000)]
    assert got == sorted(((*r, t, len(t)) for r, t in zip(rows, texts)), key=str)
    assert main_text.main_text(pages).columns[-2:] == ["__text", "__n_chars"] and main_text.main_text(pages.limit(0)).collect() == []


def test_query(spark, sf01):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf01}/pages.parquet").collect()}
    rows = queries.op12_main_text(spark, sf01).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html_.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, "\n".join(p for p in parts if p), len(r.text))
