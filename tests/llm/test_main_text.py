from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest

from reviewlake.llm import main_text
from reviewlake.llm.main_text import extract

LONG = "A sentence that is long enough to be an article and not a link or a label of some kind."


@pytest.mark.parametrize("page,text", [
    ("", ""), ("   ", ""), ("<p></p>", ""), ("plain words", "plain words"),
    ("<p>a &amp; b&nbsp; &lt;c&gt; &#233;", "a & b <c> é"),
    (f"<nav>x</nav><article><header><h1>T</h1></header><p>{LONG}</p><p>No.</p></article>",
     f"T\n{LONG}\nNo."),
    (f"<header>site</header><main><p>{LONG}<br>more</p></main><footer>f</footer>", f"{LONG} more"),
    (f"<div class='content'><p>{LONG}<p>b</div><div class='sidebar'><p>{LONG}</p></div>",
     f"{LONG}\nb"),
    (f"<article><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form></article>", LONG),
    (f"<article>{LONG}</article><section id='user-comments'><article>{LONG} no</article></section>",
     LONG),
    (f"<article>{LONG}<script>if (a</p>b) '<p>'</script><style>p</style><!-- c --></article>", LONG),
    (f"<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table>{LONG}</article>",
     f"one\ntwo\nx\ny\n{LONG}"),
    (f"<article><p><b>{LONG}<br><p>next</article><footer>&copy; &middot;</footer", f"{LONG}\nnext"),
    (f"<article><p>{LONG} cut &am", f"{LONG} cut &am"),
    (f"<article><p>in<b>side</b> word</p><p hidden>no</p>{LONG}</article>", f"inside word\n{LONG}"),
    ("<div><a>Home</a> <a>News</a> <a>About</a> <a>More</a></div>"
     f"<div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div>"
     "<div><a>Terms</a> <a>Privacy</a> <a>Jobs</a> <a>Press</a></div>",
     f"Title\n{LONG}\n{LONG}\nShort."),
])
def test_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("page,text", [
    (f"<div class='has-sidebar'><article><p>{LONG}</p><div class='share'>no</div></article></div>",
     LONG),
    (f"<p>Site</p><div class='content-sidebar-wrap'><main><p>{LONG}</p></main>"
     "<div class='sidebar'>no</div></div>", LONG),
    (f"<div id='search-results'><p>{LONG}</p><p>{LONG}</p><div class='menu'>no</div></div>",
     f"{LONG}\n{LONG}"),
    (f"<div class='no-comments'><p>{LONG}</p></div>", LONG),
    (f"<div><p>{LONG}</p></div><div id='comments'><article>{LONG} no</article></div>", LONG),
    (f"<article><p>{LONG} <span class='ad'>no</span></p></article>", LONG),
    (f"<div class='logo'>Site name here</div><div class='has-sidebar'><article><p>{LONG}</p>"
     "</article></div>", LONG),
    (f"<div class='page sidebar-left'><div class='ad'>no</div><article><p>{LONG}</p></article></div>",
     LONG),
    (f"<h1>Title</h1><div class='content no-comments'><p>{LONG}</p></div>", LONG),
    (f"<h1>Title</h1><div class='page-widget'><p>{LONG}</p><p>{LONG}</p></div>",
     f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><article class='comment'>{LONG} no</article></article>", LONG),
    (f"<article><p>{LONG}</p></article><article class='comment'>{LONG} no {LONG}</article>", LONG),
    (f"<article class='comment'>{LONG} no {LONG}</article><article><p>{LONG}</p></article>", LONG),
    (f"<article><h1>T</h1></article><div class='ad'>{LONG} no {LONG}</div>", "T"),
    (f"<p>{LONG}</p><p>{LONG}</p><div id='comments'><article>{LONG}</article></div>",
     f"{LONG}\n{LONG}"),
    (f"<article class='card'>Teaser</article><div><p>{LONG}</p><p>{LONG}</p></div>",
     f"{LONG}\n{LONG}"),
    (f"<article>{LONG}<p style='color: red; display : NONE'>no</p><p aria-hidden>no</p></article>",
     LONG),
    (f"<article>{LONG}<p style='display: block' aria-hidden='false'>yes</p></article>",
     f"{LONG}\nyes"),
])
def test_hints_of_layout(page, text):
    assert extract(page) == text


def test_all_given_pages(spark, sf_dir):
    """Pages of the tables name their article; all of its blocks come out, and nothing else."""
    rows = main_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(raw)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", raw[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", " ", b))
                  for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(" ".join(b.split()) for b in blocks if b.strip())
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "u", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS text", "1 AS n_chars")
    got = sorted(main_text.main_text(pages).collect(), key=str)
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (1, 0), (2, 999_999), (None, 0)]
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_smoothing_and_threshold():
    values = np.array([1.0, 1, 1, 50, 60, 55, 1, 1])
    smooth = main_text.smoothed(values)
    assert len(smooth) == 8 and smooth.argmax() == 4
    plain = [sum(v * np.exp(-(i - j) ** 2 / 2) for j, v in enumerate(values) if abs(i - j) <= 3)
             / sum(np.exp(-(i - j) ** 2 / 2) for j in range(8) if abs(i - j) <= 3)
             for i in range(8)]
    assert np.allclose(smooth, plain)
    assert 1 < main_text.threshold(values) < 50
    assert main_text.threshold(np.array([7.0, 7.0])) == 7


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "text", "<div class='ad'>" * 200_000 + "text",
    "<ul>" + "<div>" * 100_000 + "<li>a</li>" * 100_000,
    "<b>" * 100_000 + "</i>" * 100_000 + "<p>x" * 100_000])
def test_time_grows_with_the_events(page):
    began = time.perf_counter()
    extract(page)
    assert time.perf_counter() - began < 10
