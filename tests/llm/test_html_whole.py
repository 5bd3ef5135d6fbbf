"""Pages whose text must not end at an unclosed element."""
import pytest

from foliospark.llm import html


def texts(page):
    return " ".join(t for _, t in html.parse(page)[1])


@pytest.mark.parametrize("tag", "template iframe svg math object select button option canvas audio video noscript".split())
def test_unclosed(tag):
    assert texts(f"<article><p>one <{tag}>two<p>three</article><p>four").split() == ["one", "two", "three", "four"]


def test_head_without_end():
    page = "<!DOCTYPE html><html><head><meta charset=utf-8><title>no</title><style>p {}</style><article><p>one<p>two</article>"
    assert texts(page) == "one two"
    assert html.main_text(page, html.trained()) == "one\n\ntwo"
    assert texts("<head><title>no</title></head><body><p>one") == "one"


def test_inside_the_article():
    page = "<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be<svg><path d='x'/><circle /></svg><p>next<script>no</script><textarea>no</textarea></article>"
    assert texts(page) == "let x=1 be next"


@pytest.mark.parametrize("mark", ["data-y='3'", "data-y=3", "data-y", "data-y=\"x\"", "data-y=\"\""])
def test_marks_of_real_pages(mark):
    assert texts(f"<p {mark}>one") == "one"


CASES = {
    '<body><div class="post"><p>Nice notice about ads</p></div></body>': "Nice notice about ads",
    "<body><p>One two three.</p><p>More text here.</p></body>": "One two three.\n\nMore text here.",
    '<article><p>x y z w.</p></article><section id="comments"><h2>Comments</h2><p>reader says hi</p></section>': "x y z w.",
    "<article><p>one two three four.</p><form><label>Name</label><input></form><p>five</p></article>": "one two three four.\n\nfive",
    "<body><header><h1>Site</h1></header><main><h2>Art</h2><p>text one two.</p><aside>related</aside><blockquote>quote</blockquote></main><footer>foot</footer></body>": "Art\n\ntext one two.\n\nquote",
    '<body><div class="cookie-notice">We use cookies</div><div id="content"><h1>Title</h1><table><tr><td>a</td><td>b</td></tr></table></div></body>': "Title\n\na\n\nb",
    '<body><div class="sidebar">Links</div><div class="story"><p>text text</p></div><div class="advert">buy</div></body>': "text text",
}


@pytest.mark.parametrize("page", CASES)
def test_small_pages(page):
    assert html.main_text(page, html.trained()) == CASES[page]


def test_very_long_page():
    body = "".join(f"<p>word{i} and some more of it.</p>" for i in range(20_000))
    assert len(html.main_text(f"<nav>menu</nav><article>{body}</article>", html.trained()).split("\n\n")) == 20_000
