"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements; text belongs to the nearest block.  Each node is content or not.  Its
potential comes from its tag, the words of its class, id and role, a copyright sign, the share of links in its text and its size;
each edge has a potential of the parent's and the child's label.  Sum-product messages go up from the leaves
and down from the root and give every node's marginal.  The weights are trained by gradient ascent on the likelihood
(observed less expected counts, both from the same messages) of labelled pages.  The labelled pages come from a seeded
generator of layouts, `labelled_page`; their number and the epochs are parameters.  A block whose
marginal is at least a half is part of the text; what script, style, textarea and title hold is never text, nor what a
browser does not show: template, noscript, and blocks with the attribute hidden.

Nulls: a null html is the empty page, with no text; a null page_id or url stays null.  Repeated rows are read one by
one; extra columns are ignored; an empty table gives an empty result.  Truncated and unclosed markup is read as a
browser does, roughly: blocks end an open paragraph, list items end list items, and what is open ends with the page.
"""
from __future__ import annotations

import math
import random
import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import table, through_python

PAGES, EPOCHS, SEED = 1200, 12, 11

# Elements of HTML by how they are read.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mpadded mspace mtable mtr mtd semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table td th tr ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body aside nav".split())
# An attribute as browsers read it: a stray quote is part of a name or of a value without quotes; a quote that is not closed runs on.
_ATTR = r"(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)?))?"
ATTR = re.compile(_ATTR)
_PLAIN = re.sub(r"\((?!\?)", "(?:", _ATTR)  # without groups
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _PLAIN + r")*+)(?:>|\Z)", re.S)
#: What a browser with scripts never shows; without an end tag, what follows counts as the page's.
UNSHOWN = {x: re.compile(f"</{x}", re.I) for x in ("template", "noscript")}
HINTS = ("class", "id", "role", "aria-label", "itemprop", "aria-hidden")


class Node:
    __slots__ = ("tag", "hints", "parent", "kids", "parts", "links", "y", "off")

    def __init__(self, tag: str, parent: Node | None, hints: str = "", y: int | None = None, off: bool = False):
        self.off = off or bool(parent and parent.off)  # not shown: its text is none of the page's
        self.tag, self.parent, self.hints, self.kids, self.parts, self.links, self.y = tag, parent, hints, [], [], 0, y
        if parent:
            parent.kids.append(self)


def parse(html: str, marks: bool = False) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Nodes, parents first, and the blocks: (node, text) in page order; with `marks`, data-y is read as the label."""
    root = Node("body", None)
    nodes, blocks, at, here = [root], [], 0, root
    buffer: list[str] = []
    ends: dict[str, int | None] = {}  # the next end tag of what is not shown; None: there is none ahead
    link = 0

    def flush():
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text and not here.off:
                here.parts.append(len(text))
                if text[0] == "\u00a9" or text[:9].lower() == "copyright":
                    here.hints += " copyright"
                blocks.append((here, text))

    def close(names, stop=SCOPE):
        """Ends the nearest open element of these names, unless one of `stop` lies nearer."""
        nonlocal here
        n = here
        while n is not root and n.tag not in names:
            if n.tag in stop:
                return
            n = n.parent
        if n is not root:
            flush()
            here = n.parent

    while at < len(html):
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            buffer.append(text)
            if link:
                here.links += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                link = 0
            elif name == "br":
                buffer.append(" ")
            elif name not in INLINE and name not in ("html", "head", "body"):
                close({name}, frozenset())
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(html)
            continue
        if name in INLINE:
            if name == "a":
                link = 1
            elif name == "br":
                buffer.append(" ")
            continue
        if name in ("html", "head", "body"):  # a head holds no text but that of raw elements, closed or not
            continue
        if name in CLOSES_P:
            close({"p"})
        if name in SAME:
            close(SAME[name], SCOPE - {"tr"} if name == "tr" else SCOPE)
        flush()
        hints, y, off = [], None, False
        if name in UNSHOWN and (name not in ends or (ends[name] is not None and ends[name] <= at)):
            end = UNSHOWN[name].search(html, at)
            ends[name] = end.end() if end else None
        if name in UNSHOWN:
            off = ends.get(name) is not None
        for k, a, b, c in ATTR.findall(m[3]):
            if (k := k.lower()) == "hidden":
                off = True
            elif k in HINTS:
                hints.append(a or b or c)
            elif marks and k == "data-y":
                y = int(a)
        if name in VOID:
            continue
        if m[3].rstrip().endswith("/"):  # drawings close their elements so
            n = here
            while n and n.tag != "svg":
                n = n.parent
            if n or name == "svg":
                continue
        here = Node(name, here, " ".join(hints), y, off)
        nodes.append(here)
    flush()
    return nodes, blocks


WORDS = re.compile(r"[A-Z]?[a-z]+")


def features(n: Node) -> list[str]:
    size = sum(n.parts)
    out = ["bias", f"tag:{n.tag}"]
    if not n.hints:
        out.append(f"bare:{n.tag}")
    else:
        out += [f"hint:{w}" for w in {x.lower().removesuffix("s") for x in WORDS.findall(n.hints)}]
    if size:
        out.append("links:most" if 2 * n.links > size else "links:some" if n.links else "text")
        out.append(f"size:{min(size, 400).bit_length()}")
    return out


class TreeModel:
    """weights: potentials of features for the label content; edge[p][c]: of a parent's and a child's label."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.edge = [[0.0, 0.0], [0.0, 0.0]]

    def marginals(self, nodes: list[Node], feats: list[list[str]] | None = None) -> tuple[list[float], list[list[list[float]]]]:
        """P(content) of each node, and P(parent's label, node's label) of each node but the root.

        nodes: parents first.  Messages are kept as probabilities, scaled at each node."""
        place = {id(n): i for i, n in enumerate(nodes)}
        up_of = [place[id(n.parent)] if n.parent else -1 for n in nodes]
        own = [math.exp(max(-30.0, min(30.0, sum(self.weights.get(f, 0.0) for f in fs)))) for fs in (feats or map(features, nodes))]
        e = [[math.exp(v) for v in row] for row in self.edge]
        belief = [[1.0 / (1 + o), o / (1 + o)] for o in own]  # own potential and all messages from below
        up = [[0.5, 0.5]] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            b0, b1 = belief[i]
            m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
            up[i] = [m0 / (m0 + m1), m1 / (m0 + m1)]
            p = belief[up_of[i]]
            p0, p1 = p[0] * up[i][0], p[1] * up[i][1]
            s = p0 + p1 or 1e-300
            belief[up_of[i]] = [max(p0 / s, 1e-12), max(p1 / s, 1e-12)]
        pair: list[list[list[float]]] = [[[0.0, 0.0], [0.0, 0.0]]]
        for i in range(1, len(nodes)):  # the parent's belief without this node's own message, sent down
            p = belief[up_of[i]]
            q0, q1 = p[0] / up[i][0], p[1] / up[i][1]
            b0, b1 = belief[i]
            j = [[q0 * e[0][0] * b0, q0 * e[0][1] * b1], [q1 * e[1][0] * b0, q1 * e[1][1] * b1]]
            s = j[0][0] + j[0][1] + j[1][0] + j[1][1]
            j = [[v / s for v in row] for row in j]
            pair.append(j)
            belief[i] = [max(j[0][0] + j[1][0], 1e-12), max(j[0][1] + j[1][1], 1e-12)]
        return [b[1] for b in belief], pair

    def train(self, pages: list[list[Node]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> TreeModel:
        feats = [[features(n) for n in nodes] for nodes in pages]
        scale: dict[str, float] = {}
        for _ in range(epochs):
            for nodes, fs in zip(pages, feats, strict=True):
                p, pair = self.marginals(nodes, fs)
                place = {id(n): i for i, n in enumerate(nodes)}
                grad: dict[str, float] = {}
                for n, f, q in zip(nodes, fs, p, strict=True):
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + n.y - q
                for x, g in grad.items():
                    scale[x] = scale.get(x, 1.0) + g * g
                    w = self.weights.get(x, 0.0)
                    self.weights[x] = w + rate * (g / math.sqrt(scale[x]) - decay * w)
                for a in (0, 1):
                    for b in (0, 1):
                        g = sum((nodes[place[id(n.parent)]].y == a and n.y == b) - pair[i][a][b] for i, n in enumerate(nodes) if i)
                        k = f"edge{a}{b}"
                        scale[k] = scale.get(k, 1.0) + g * g
                        self.edge[a][b] += rate * g / math.sqrt(scale[k])
        return self


def labelled_page(r: random.Random) -> str:
    """A page with data-y on its blocks: 1 for the article, 0 for the rest; blocks without it are as their parents."""
    syllable = ["ta", "ren", "o", "mi", "lus", "ka", "ver", "ein", "que", "son", "th", "er", "al"]
    word = lambda: "".join(r.choice(syllable) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", ".", "", "!", " |"])
    cls = lambda *names: (f' class="{r.choice(names)}"' if r.random() < 0.75 else f' id="{r.choice(names)}"')
    any_ = lambda: r.choice(["", "", f' class="{r.choice(["row", "col", "wrap", "container", "inner", "block", "box", "widget", "x" + word()])}"'])
    items = lambda n: "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(n))
    ps = lambda a, b, lo=3, hi=60: "".join(f"<p{any_()}>{say(lo, hi)}</p>" for _ in range(r.randint(a, b)))

    def junk(inside: bool) -> str:
        inner = r.choice([lambda: say(2, 40), lambda: ps(1, 3, 2, 40), lambda: f"<ul>{items(r.randint(2, 6))}</ul>", lambda: f"<h3>{say(1, 4)}</h3>{ps(1, 2)}", lambda: f"<div>{say(2, 30)}</div>"])
        kinds = [
            lambda: f'<div data-y="0"{cls("ad", "ads", "advert", "ad-slot", "advertisement", "banner", "promo", "sponsored", "sponsor")}>{inner()}</div>',
            lambda: f'<aside data-y="0"{r.choice(["", cls("sidebar", "related", "widget")])}>{inner()}</aside>',
            lambda: f'<div data-y="0"{cls("sidebar", "side-bar", "related", "related-posts", "recommended", "widget-area", "more-stories", "trending")}>{inner()}</div>',
            lambda: f'<{(t := r.choice(["div", "section", "ol", "ul"]))} data-y="0"{cls("comments", "comment-list", "comment", "commentlist", "responses", "discussion", "reader-comments", "replies", "disqus")}>'
            + (f"<li>{say(3, 60)}</li><li>{ps(1, 2)}</li>" if t in ("ol", "ul") else r.choice([f'<h3>{say(1, 3)}</h3><div class="comment">{ps(1, 3)}</div><div class="reply">{inner()}</div>', f"<h{r.randint(2, 4)}>{say(1, 3)}</h2>{ps(1, 4)}", inner()])) + f"</{t}>",
            lambda: f'<div data-y="0"{cls("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "notification", "warning", "paywall", "disclaimer")}>{inner()}</div>',
            lambda: f'<form data-y="0"{any_()}><p>{say(2, 12)}</p><input name="q"><label>{say(1, 2)}</label></form>',
            lambda: f'<div data-y="0"{cls("newsletter", "subscribe", "signup", "share", "social", "share-buttons", "tags", "meta", "byline", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "search", "login")}>{inner()}</div>',
        ]
        if not inside:
            kinds += [
                lambda: f'<nav data-y="0"{any_()}>{r.choice([f"<ul>{items(r.randint(2, 8))}</ul>", say(2, 9), f"<div>{inner()}</div>"])}</nav>',
                lambda: f'<{r.choice(["ul"])} data-y="0"{cls("menu", "nav", "navigation", "navbar", "topnav", "main-menu")}>{items(r.randint(2, 8))}</ul>',
                lambda: f'<div data-y="0"{cls("nav", "menu", "navbar", "navigation", "topbar", "header", "masthead", "site-header", "page-header", "head")}>{inner()}</div>',
                lambda: f'<header data-y="0"{any_()}>{r.choice([f"<h1>{say(1, 4)}</h1>", f"<p>{say(1, 9)}</p>", inner()])}</header>',
                lambda: f'<footer data-y="0"{any_()}>{r.choice(["&copy; ", ""])}{inner()}</footer>',
                lambda: f'<div data-y="0"{cls("footer", "site-footer", "foot", "copyright", "legal", "bottom", "colophon")}>{inner()}</div>',
            ]
        return r.choice(kinds)()

    def block() -> str:
        return r.choice([
            lambda: ps(1, 3, 1, 90), lambda: ps(1, 2, 1, 6), lambda: ps(2, 5, 20, 120), lambda: f"<h{(k := r.randint(1, 4))}{any_()}>{say(1, 9)}</h{k}>",
            lambda: f"<ul>{''.join(f'<li>{say(1, 30)}</li>' for _ in range(r.randint(1, 6)))}</ul>", lambda: f"<ol>{''.join(f'<li>{say(1, 30)}' for _ in range(r.randint(1, 4)))}</ol>",
            lambda: f"<blockquote>{r.choice([say(2, 40), ps(1, 2)])}</blockquote>", lambda: f"<pre>{say(3, 40)}</pre>",
            lambda: f"<table><tr><th>{say(1, 3)}</th></tr><tr><td>{say(1, 9)}</td><td>{say(1, 3)}</td></tr></table>", lambda: f"<div{any_()}>{r.choice([say(3, 60), ps(1, 3)])}</div>",
            lambda: f"<section{any_()}><h2>{say(1, 5)}</h2>{ps(1, 3)}</section>", lambda: f'<p>{say(3, 30)} <a href="/{word()}">{say(1, 5)}</a> {say(1, 30)}',
            lambda: f'<figure><img src="x"><figcaption>{say(2, 9)}</figcaption></figure>', lambda: f"<dl><dt>{say(1, 3)}</dt><dd>{say(2, 20)}</dd></dl>", lambda: f"<button>{say(1, 3)}{r.choice(['</button>', '', '<p>' + say(3, 30)])}",
        ])()

    body = ""
    if r.random() < 0.9:
        body += f"<h1>{say(2, 12)}</h1>"
    elif r.random() < 0.5:
        body += f'<header data-y="1"><h1>{say(2, 12)}</h1></header>'
    for _ in range(r.randint(1, 9)):
        body += block() if r.random() < 0.85 else junk(True)
    for _ in range(r.choice([0, 0, 0, 0, 1, 3, 9])):  # wrappers in wrappers
        body = f"<div{any_()}>{body}</div>"
    kind = r.choice(["article", "article", "main", "div", "section", "plain"])
    if kind == "plain":
        art = f'<div data-y="1">{body}</div>'
    else:
        art = f'<{kind} data-y="1"{cls("article", "content", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "text", "page-content", "body") if kind in ("div", "section") else any_()}>{body}</{kind}>'
    if r.random() < 0.3:
        art = f"<main{any_()}>{art}</main>"
    bare = lambda: f'<div data-y="0">{r.choice([f"&copy; {r.randint(1999, 2025)} {say(1, 3)}", f"<a href=/x>{say(1, 2)}</a> <a href=/y>{say(1, 2)}</a> <a href=/z>{say(1, 2)}</a>"])}</div>'
    before, after = r.choice([(0, 0), (0, 2), (1, 3), (3, 4)])
    out = "".join(junk(False) if r.random() < 0.9 else bare() for _ in range(r.randint(before, 4) if before or after else 0)) + art + "".join(junk(False) if r.random() < 0.9 else bare() for _ in range(r.randint(0, after)))
    if r.random() < 0.3:
        out = f'<div class="{r.choice(["wrapper", "page", "container", "layout", "site"])}">{out}</div>'
    for _ in range(r.choice([0, 0, 0, 0, 1, 4, 12])):
        out = f"<div{any_()}>{out}</div>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{out}</body></html>"


def labelled(html: str) -> list[Node]:
    nodes, _ = parse(html, marks=True)
    nodes[0].y = 1
    for n in nodes[1:]:
        if n.y is None:
            n.y = n.parent.y
    return nodes


_MODELS: dict[tuple, TreeModel] = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> TreeModel:
    """The model of so many generated pages; trained once a process, the same everywhere."""
    key = pages, epochs, seed
    if key not in _MODELS:
        r = random.Random(seed)
        _MODELS[key] = TreeModel().train([labelled(labelled_page(r)) for _ in range(pages)], epochs)
    return _MODELS[key]


def main_text(html: str | None, model: TreeModel) -> str:
    nodes, blocks = parse(html or "")
    p = dict(zip(map(id, nodes), model.marginals(nodes)[0], strict=True))
    return "\n\n".join(text for n, text in blocks if p[id(n)] >= 0.5)


def extract(df: DataFrame, pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(page_id, url, text, n_chars)"""
    model = trained(pages, epochs, seed)
    weights, edge = model.weights, model.edge

    def run(batches):
        own = TreeModel()
        own.weights, own.edge = weights, edge
        for b in batches:
            text = [main_text(h if isinstance(h, str) else None, own) for h in b["html"]]
            yield b[["page_id", "url"]].assign(text=pd.Series(text, dtype=object), n_chars=pd.Series([len(t) for t in text], dtype="int64"))

    return through_python(df.select("page_id", "url", "html"), ("page_id",), run, "url string, text string, n_chars long")


def op6(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
