from __future__ import annotations

import re
import time
from html import unescape

import pytest

from blockframe.llm import html

BODY = "This is a paragraph that is long enough to be what the page is about, with commas and all. "


def page(inner: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{inner}</body></html>"


def test_article_without_what_surrounds_it():
    text = html.main_text(
        page(
            "<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
            f"<article><h1>Title &amp; more</h1><p>{BODY}</p><p>Short.</p><div class='ad'>Buy</div><form><label>Mail</label><button>Go</button></form>"
            f"<script>var a='</p>';</script><ul><li>one</li><li>two</li></ul><p>{BODY}a &lt; b&nbsp; c</p><section id='comments'><p>Nice! {BODY}</p></section></article>"
            "<aside>Related</aside><footer>&copy; 2024</footer>"
        )
    )
    body = BODY.strip()
    assert text.split("\n") == ["Title & more", body, "Short.", "one", "two", f"{body} a < b c"]


def test_page_without_an_article_element():
    text = html.main_text(
        page(
            "<div id=menu><a href=1>One</a><a href=2>Two</a></div><div class=wrap><div class=content><h2>Head</h2>"
            f"<p>{BODY}</p><p>{BODY * 2}</p><p>Mid.</p><p>{BODY}</p></div><div class=sidebar><p>Side {BODY}</p></div></div><div class=footer>x</div>"
        )
    )
    assert text.split("\n") == ["Head", BODY.strip(), (BODY * 2).strip(), "Mid.", BODY.strip()]


def test_innermost_marked_element():
    inner = f"<article><header><h1>Head</h1></header><p>{BODY}</p><p>{BODY}</p></article>"
    text = html.main_text(page(f"<main><div><span>Home</span> &gt; <span>News</span></div>{inner}<p>See also</p></main>"))
    assert text.split("\n") == ["Head", BODY.strip(), BODY.strip()]
    two = html.main_text(page(f"<main><article><p>{BODY}</p></article><article><p>{BODY}x</p></article></main>"))
    assert two.split("\n") == [BODY.strip(), f"{BODY}x"]


@pytest.mark.parametrize("raw", ["", "   ", "<html></html>", "<!-- only -->", "<script>x</script>", "<nav><a>m</a></nav>", "<", "<a", "&", "<p", "</p></p>", "<!DOCTYPE"])
def test_no_content(raw):
    assert html.main_text(raw) in ("", "<", "&")


def test_malformed_markup_and_long_pages():
    assert html.main_text(f"<article><p><b>{BODY}<br><p>{BODY}") == f"{BODY.strip()}\n{BODY.strip()}"
    long = html.main_text(page("<article>" + f"<p>{BODY}</p>" * 20_000 + "</article>"))
    assert long.count("\n") == 19_999


def test_pages_against_their_template(spark, sf):
    """The pages' own template: an article whose blocks are its h1 and p elements."""
    from blockframe.llm.queries import op8_html

    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op8_html(spark, sf).collect()
    assert len(rows) == len(raw)
    for r in rows:
        body = re.search(r"(?s)<article>(.*)</article>", raw[r.page_id]).group(1).replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (2, "<p>Hello there</p>", None)], "page_id long, html string, text string")
    out = html.extract(df)
    assert out.columns == ["page_id", "html", "text"]
    assert sorted(r.text for r in out.collect()) == ["", "", "Hello there"]
    assert html.extract(df.limit(0)).collect() == []


PRICES = "<table>" + "".join(f"<tr><td><b>item</b><i>no</i><u>{i}</u></td><td><b>{i}</b><i>.</i><u>99</u> <s>EUR</s></td></tr>" for i in range(200)) + "</table>"


def test_the_clusters_decide(monkeypatch):
    """A table has more characters than the text beside it, but a low ratio: without the clusters all would be returned."""
    inner = page(f"<div>{PRICES}</div><div><p>{BODY}</p><p>{BODY * 2}</p><p>{BODY}</p></div>")
    want = [BODY.strip(), (BODY * 2).strip(), BODY.strip()]
    assert html.main_text(inner).split("\n") == want
    monkeypatch.setattr(html, "content_lines", lambda ratio: ratio >= 0)
    assert html.main_text(inner).split("\n") != want


def test_a_teaser_is_not_the_article():
    teaser = "<article><h3>Other</h3><p>Read on.</p></article>"
    text = html.main_text(page(f"<div><h1>Head</h1><p>{BODY * 3}</p><p>{BODY}</p><p>{BODY}</p></div>{teaser}"))
    assert text.split("\n") == ["Head", (BODY * 3).strip(), BODY.strip(), BODY.strip()]


def test_names_do_not_elect_the_region(monkeypatch):
    monkeypatch.setattr(html, "MARKS", frozenset())
    inner = page(f"<div class=menu>{'<a href=x>link</a> ' * 50}</div><div class=text><p>{BODY * 3}</p><p>{BODY * 2}</p></div><div>{PRICES}</div>")
    assert html.main_text(inner).split("\n") == [(BODY * 3).strip(), (BODY * 2).strip()]


@pytest.mark.parametrize("opened", ["<div>", "<span>", "<p><b>", "<span>x<h1>", "<li>", "<table><tr><td>", "<div>x</section>", "<i></b><h1></h1>"])
def test_deep_and_unclosed_pages_take_time_in_proportion(opened):
    start = time.process_time()
    html.main_text(page(opened * (1_000_000 // len(opened)) + BODY))
    assert time.process_time() - start < 30
