from __future__ import annotations

import re
from pathlib import Path

import pytest

from blockframe.llm import html

BODY = "This is a paragraph that is long enough to be what the page is about, with commas and all."
ARTICLE = f"<article><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></article>"
WANT = ["Head", BODY, BODY]


def lines(inner: str) -> list[str]:
    return html.main_text(f"<html><body>{inner}</body></html>").split("\n")


@pytest.mark.parametrize("name", ["layout has-sidebar", "page no-header", "content-widget", "ad-free", "sidebar", "widget menu-open"])
@pytest.mark.parametrize("key", ["class", "id"])
def test_a_wrapper_of_the_article_does_not_surround_it(name, key):
    inner = f"<div {key}='{name}'>{ARTICLE}</div>"
    assert lines(inner) == WANT
    assert lines(f"<div class='sidebar'><p>Side {BODY}</p></div>{inner}<div class='site-footer'>{BODY}</div>") == WANT


@pytest.mark.parametrize("head", ["<header class='article-header'><h1>Head</h1></header>", "<div class='entry-header'><h1>Head</h1></div>", "<div class='header'><h1>Head</h1></div>"])
def test_an_articles_own_header_stays(head):
    assert lines(f"<article>{head}<p>{BODY}</p><p>{BODY}</p></article>") == WANT
    assert lines(f"<main>{head}<p>{BODY}</p><p>{BODY}</p></main>") == WANT


def test_wrapper_without_an_article_element():
    assert lines(f"<div class='widget'><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div><div class='sidebar'><p>Side</p></div>") == WANT


def test_what_surrounds_still_goes():
    around = "<div class='ad-slot'>Buy</div><div class='cookie-notice'>Cookies</div><div id='main-nav'>Menu</div>"
    talk = f"<div class='comments-area'><article class='comment'><p>{BODY * 9}</p></article><article><p>{BODY * 9}</p></article></div>"
    assert lines(f"{around}<div class='wrap'>{ARTICLE}{talk}</div>") == WANT
    assert lines(ARTICLE.replace("</article>", f"{around}{talk}</article>")) == WANT


PIECES = [
    "<section id='related-work'><p>Kept one.</p></section>",
    "<section id='comments-on-method'><p>Kept one.</p></section>",
    "<h2 id='notice-periods'>Kept one.</h2>",
    "<h2 id='menu'>Kept one.</h2>",
    "<h2 class='banner'>Kept one.</h2>",
    "<div class='share-price'>Kept one.</div>",
]


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("piece", PIECES)
def test_names_of_what_an_article_says_drop_nothing(piece, tag):
    inner = f"<nav><a href=x>Home</a></nav><{tag}><h1>Head</h1><p>{BODY}</p>{piece}<p>{BODY}</p></{tag}><footer>Foot</footer>"
    assert lines(inner) == ["Head", BODY, "Kept one.", BODY]


@pytest.mark.parametrize("name", ["comments", "ad-slot-2", "share-buttons", "related-posts", "main-menu", "newsletter-form"])
def test_names_that_say_nothing_else_still_count(name):
    assert lines(f"<article><h1>Head</h1><p>{BODY}</p><div class='{name}'>Gone.</div><p>{BODY}</p></article>") == WANT


def test_one_long_notice_beside_a_short_article():
    assert lines(f"<div class='ad'>{BODY * 9}</div><div><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div>") == WANT
    assert lines(f"<div class='ad'>{BODY}</div>") == [BODY]


def test_a_list_or_paragraph_is_not_a_region():
    assert lines(f"<div><h1>Head</h1><p>{BODY * 20}</p></div><footer>Foot</footer>") == ["Head", BODY * 20]
    items = [f"{BODY} {i}" for i in range(9)]
    assert lines(f"<div><h1>Head</h1><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></div><footer>Foot</footer>") == ["Head", *items]


def test_given_pages_without_their_tags(spark, sf, monkeypatch):
    """With article, nav and footer renamed and classes taken away only ratios tell content: most pages still give their article,
    and without the clusters fewer do. With the article alone renamed, all do."""
    pages = [r.html for r in spark.read.parquet(f"{Path(sf).parent}/sf0.1/pages.parquet").select("html").where("html is not null").collect()]
    want = [html.main_text(x) for x in pages]
    assert [html.main_text(re.sub(r"<(/?)article\b", r"<\1div", x)) for x in pages] == want
    bare = [re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", x).replace(' class="ad"', "") for x in pages]
    found = sum(html.main_text(x) == w for x, w in zip(bare, want, strict=True))
    assert found >= 0.9 * len(pages)
    monkeypatch.setattr(html, "content_lines", lambda ratio: ratio >= 0)
    assert sum(html.main_text(x) == w for x, w in zip(bare, want, strict=True)) < found
