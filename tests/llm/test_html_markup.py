"""Broken attributes and what is not shown."""
import time

import pytest

from foliospark.llm import html

LONG = "A sentence of the article that goes on for a while, so that it counts as one of its paragraphs. "


def texts(page):
    return [t for _, t in html.parse(page)[1]]


@pytest.mark.parametrize("tag", ['p class="a""', "p title=5\"", "p a=b'c", "p '", "p =x", "p a = 'x>y' b", "p/", 'p data-x="<b>"', "P\n\tclass=a"])
def test_odd_attributes(tag):
    assert texts(f"<div><{tag}>Hello <b>there</b></p></div>") == ["Hello there"]


def test_not_shown():
    page = "<div><p>One</p><div hidden><p>Two</p></div><noscript><p>Turn scripts on</p></noscript><template><p>Three</p></template><p hidden=''>Four</p><p class=hidden-gem>Five</p></div>"
    assert texts(page) == ["One", "Five"]


def test_quote_that_is_not_closed():
    assert texts("<p>One</p><p class=\"x>Two</p><p>Three") == ["One"]


def test_long_tags_take_linear_time():
    t = time.time()
    for junk in ("a" * 200_000, "a=" * 100_000, "\" " * 100_000, "<" * 200_000, "<a " * 60_000, "= " * 100_000):
        html.parse(f"<p>{LONG}</p><p {junk}")
    assert time.time() - t < 20


def test_whole_page(spark):
    page = f"<html><body><nav class=menu><a href=/>Home</a></nav><article><h1>Title of it all</h1><p class=\"a\"\">{LONG * 3}</p><div hidden>{LONG * 3}</div><p>{LONG * 4}</p></article><noscript>Please enable scripts</noscript></body></html>"
    got = html.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    want = "\n\n".join(" ".join((LONG * k).split()) for k in (3, 4))
    assert got.text.endswith(want) and "<" not in got.text and got.n_chars == len(got.text)
