"""Main text of web pages by a tree-structured graphical model.

A page's DOM is a tree of hidden variables: each element is content or not.
An element's own evidence (tag, class and id words, length and link share of
its text) gives its node potential, and a potential on every parent-child edge
says how labels go down the tree, by the child's tag. Sum-product messages go
up from the leaves and down from the root; the product at a node is its exact
marginal. The text of the blocks whose element is content with a probability of
at least one half is the page's text.

Both kinds of potentials are trained by counting on labelled pages: HTML whose
elements carry ``data-content`` 1 or 0 (an element without the mark has its
parent's). ``LABELLED`` holds a small set of such pages, of common layouts;
``train`` takes any others.

A page is parsed as browsers do it where it matters here: void elements,
implied ends of paragraphs, list items, rows and cells, end tags without a
start, elements that are never closed; an open head ends where something that
does not belong into it begins. Scripts, styles, templates, comments
and the document's head are markup, not text. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by a line feed.

Defined cases: a null or empty html, and a page without content, give an empty
text; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is markup.
SILENT = frozenset("head script style noscript template title iframe object svg math canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output "
                   "progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag that ends an open element of these kinds, up to the nearest of the barriers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
        "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that may stand in the head; any other, and text, ends it.
HEAD = frozenset("base link meta noframes noscript script style template title".split())
SCOPE = frozenset("html body table td th caption button object".split())

_NAME = re.compile(r"[a-z]+|[0-9]+")


class Tree(HTMLParser):
    """Elements in page order: tag, parent, names, text, and blocks of text."""

    def __init__(self, marks: bool = False):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.names, self.marks = ["#page"], [-1], [()], [None]
        self.own, self.linked = [0], [0]  # characters of text in the element itself; of these inside links
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # depths of the open elements, by tag
        self.block_of = [0]  # the nearest element around each one, itself included, that is not inline
        self.blocks: list[tuple[int, list[str]]] = []  # (element, pieces)
        self.fresh_block = True
        self.silent = self.links = 0
        self.with_marks = marks

    def _push(self, tag: str, attrs: list) -> None:
        names, mark = [], None
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                names += _NAME.findall(v.lower())
            elif k == "data-content" and self.with_marks:
                mark = int(v == "1")
        parent = self.open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(tuple(dict.fromkeys(names)))
        self.marks.append(self.marks[parent] if mark is None else mark)
        self.own.append(0)
        self.linked.append(0)
        self.block_of.append(self.block_of[parent] if tag in INLINE else len(self.tags) - 1)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tags) - 1)
        self.silent += tag in SILENT
        self.links += tag == "a"
        if tag not in INLINE:
            self.fresh_block = True

    def _pop(self) -> None:
        tag = self.tags[self.open.pop()]
        self.at[tag].pop()
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        if tag not in INLINE:
            self.fresh_block = True

    def _end(self, kinds, barriers) -> None:
        """Close the nearest open element of these kinds, and what is in it."""
        depth = max((self.at[t][-1] for t in kinds if self.at.get(t)), default=0)
        if depth and all(depth >= self.at[t][-1] for t in barriers if self.at.get(t)):
            while len(self.open) > depth:
                self._pop()

    def _end_head(self) -> None:
        if self.tags[self.open[-1]] == "head":
            self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body") and self.at.get(tag):
            return
        if tag not in HEAD:
            self._end_head()
        if tag == "body":
            self._end({"head"}, set())
        if tag in ENDS:
            self._end(*ENDS[tag])
        elif tag in ENDS_P:
            self._end({"p"}, SCOPE)
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.fresh_block = True
            return
        self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end({tag}, () if tag in SCOPE else SCOPE - {"button"} if tag not in ("body", "html") else ())

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if self.silent:
            return
        at = self.block_of[self.open[-1]]
        if self.fresh_block or self.blocks[-1][0] != at:
            if not data.strip():
                return
            self.blocks.append((at, []))
            self.fresh_block = False
        self.blocks[-1][1].append(data)
        n = len(data.strip())
        self.own[at] += n
        self.linked[at] += n * (self.links > 0)


def parsed(html: str | None, marks: bool = False) -> Tree:
    tree = Tree(marks)
    tree.feed(html or "")
    tree.close()
    return tree


def _evidence(tree: Tree) -> list[list[str]]:
    """The features of each element."""
    total, linked = list(tree.own), list(tree.linked)
    for i in range(len(total) - 1, 0, -1):
        total[tree.parents[i]] += total[i]
        linked[tree.parents[i]] += linked[i]
    out = []
    for i, tag in enumerate(tree.tags):
        share = "none" if not total[i] else "no" if linked[i] < 0.2 * total[i] else "some" if linked[i] < 0.7 * total[i] else "all"
        own = tree.own[i]
        size = 0 if own == 0 else 1 if own < 25 else 2 if own < 100 else 3
        out.append([f"tag={tag}", f"links={share}", f"size={size}", *[f"name={x}" for x in tree.names[i]]])
    return out


class Model:
    """Log potentials, by counting with add-``SMOOTH`` smoothing."""

    SMOOTH = 0.3

    def __init__(self, pages: list[str]):
        self.node: dict[str, tuple[float, float]] = {}
        self.edge: dict[str, list[list[float]]] = {}
        count: Counter = Counter()
        label: Counter = Counter()
        pair: Counter = Counter()
        kinds: dict[str, set[str]] = {}
        for html in pages:
            tree = parsed(html, marks=True)
            marks = [1 if m is None else m for m in tree.marks]  # the page and its body hold the content
            for i, features in enumerate(_evidence(tree)):
                if tree.tags[i] in SILENT:
                    continue
                label[marks[i]] += 1
                for f in features:
                    count[f, marks[i]] += 1
                    kinds.setdefault(f.split("=")[0], set()).add(f)
                if i:
                    for t in (tree.tags[i], "*"):
                        pair[t, marks[tree.parents[i]], marks[i]] += 1
        s = self.SMOOTH
        for kind, seen in kinds.items():
            for f in seen:
                self.node[f] = tuple(math.log((count[f, y] + s) / (label[y] + s * (len(seen) + 1))) for y in (0, 1))
        for t in {t for t, _, _ in pair}:
            self.edge[t] = [[math.log((pair[t, a, b] + s) / (pair[t, a, 0] + pair[t, a, 1] + 2 * s)) for b in (0, 1)] for a in (0, 1)]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every element: messages up, then down."""
        n, parents = len(tree.tags), tree.parents
        own = []
        for features in _evidence(tree):
            a = b = 0.0
            for f in features:
                x = self.node.get(f)
                if x is not None:
                    a += x[0]
                    b += x[1]
            own.append([a, b])
        edges = [self.edge.get(t) or self.edge["*"] for t in tree.tags]
        # below[i]: evidence of i and all under it; up[i]: the message to its parent
        below = [list(x) for x in own]
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            e, (b0, b1) = edges[i], below[i]
            up[i] = _add(e[0][0] + b0, e[0][1] + b1), _add(e[1][0] + b0, e[1][1] + b1)
            at = below[parents[i]]
            at[0] += up[i][0]
            at[1] += up[i][1]
        # above[i]: the message from its parent
        above: list[tuple[float, float]] = [(0.0, 0.0)] * n
        out = [0.0] * n
        for i in range(n):
            if i:
                p, e = parents[i], edges[i]
                p0 = above[p][0] + below[p][0] - up[i][0]
                p1 = above[p][1] + below[p][1] - up[i][1]
                m0, m1 = _add(p0 + e[0][0], p1 + e[1][0]), _add(p0 + e[0][1], p1 + e[1][1])
                top = max(m0, m1)
                above[i] = m0 - top, m1 - top
            d = above[i][0] + below[i][0] - above[i][1] - below[i][1]
            out[i] = 1 / (1 + math.exp(d)) if d < 700 else 0.0
        return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def extract(html: str | None, model: Model) -> str:
    tree = parsed(html)
    if not tree.blocks:
        return ""
    content = model.marginals(tree)
    blocks = (" ".join("".join(pieces).split()) for at, pieces in tree.blocks if content[at] >= 0.5)
    return "\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, model: Model | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model or default_model()
        for htmls in batches:
            yield pd.Series([extract(h, own) for h in htmls], dtype=object)

    return pages.withColumn(out_col, text(F.col(html_col)))


@functools.cache
def default_model() -> Model:
    return Model(LABELLED)


# ---- labelled pages: the layouts that the default model learns from ----------

_S = "Words of a longer sentence that tells the story of the page, with commas, and an end. "
_P = f"<p>{_S * 2}</p><p>{_S}</p><p>Yes.</p>"
_MENU = "<ul>" + "".join(f'<li><a href="/{i}">Part {i}</a></li>' for i in range(5)) + "</ul>"
_FOOT = "&copy; 2020 example.com &middot; All rights of the owners are reserved here."
_BODY = (f"<h1>A heading of the page</h1>{_P}<h2>Second part</h2><p><b>{_S}</b><br>{_S}</p><ul><li>{_S}</li><li>One point</li></ul>"
         f"<blockquote><p>{_S}</p></blockquote><table><tbody><tr><th>Name</th><td>{_S}</td></tr></tbody></table><ol><li>{_S}</li></ol>"
         f"<pre>code = 1</pre><h3>Third</h3><p>Short <a href='/x'>link</a> here.</p><figure><figcaption>{_S}</figcaption></figure>"
         f"<div><p>{_S}</p>{_S}</div><dl><dt>Term</dt><dd>{_S}</dd></dl><p><a href='/y'>A paragraph that is a link</a></p>"
         f"<h4>Fourth</h4><section><h2>Inner part</h2><p>{_S}</p></section>")


def _not(tag: str, attrs: str, inner: str) -> str:
    return f'<{tag} {attrs} data-content="0">{inner}</{tag}>'


def _labelled() -> list[str]:
    """Layouts: each kind of frame around the article, with each kind of boilerplate."""
    short = "<p>Read this now.</p>"
    boxes = [_not("div", f'class="{c}"', inner) for c, inner in (
        ("ad", _S), ("ads banner", short), ("advert advertisement", _S + _S), ("sponsored promo", f"<p>{_S}</p>"),
        ("sidebar side", f"<h3>More</h3>{_MENU}<p>{_S}</p>"), ("cookie notice consent", f"<p>{_S}</p><button>Accept</button>"),
        ("comments comment list", f"<h3>Comments</h3><div class='comment'><p>{_S}</p></div><div class='comment'><p>{_S * 2}</p></div>"),
        ("menu navigation navbar", _MENU), ("footer bottom", f"<p>{_FOOT}</p>"), ("header top masthead", "<a href='/'>Site</a><p>Slogan</p>"),
        ("breadcrumb breadcrumbs", "<a href='/'>Home</a> &gt; <a href='/a'>Part</a>"), ("share social buttons", _MENU),
        ("related recommended posts", f"<h3>Related</h3>{_MENU}"), ("newsletter subscribe signup", f"<p>{_S}</p>"),
        ("popup modal overlay", f"<p>{_S}</p>"), ("widget tags", _MENU), ("pagination pager", "<a href='/2'>Next</a>"),
        ("alert warning message", f"<p>{_S}</p>"), ("copyright legal disclaimer", f"<p>{_FOOT}</p>"), ("login search form", "<p>Log in</p>"))]
    boxes += [_not("p", f'class="{c}"', _S) for c in (
        "ad", "advert", "sponsored promo", "notice", "cookie consent", "alert warning", "disclaimer legal", "comment", "copyright", "banner ads")]
    boxes += [_not("section", f'class="{c}"', f"<h2>More</h2><p>{_S}</p>") for c in (
        "sidebar", "notice", "ads advert", "cookie", "related", "newsletter", "widget", "footer")]
    boxes += [
        _not("nav", "", _MENU), _not("nav", 'class="menu"', "<a href='/'>Home</a> <a href='/b'>About</a>"), _not("footer", "", _FOOT),
        _not("footer", 'id="footer"', f"<p>{_FOOT}</p>{_MENU}<p>{_S}</p>"), _not("header", "", "<a href='/'>Site</a><p>Slogan of the site</p>" + _MENU),
        _not("header", 'class="header"', "<h2>Site name</h2>"), _not("aside", "", f"<h3>About</h3><p>{_S}</p>{_MENU}"),
        _not("aside", 'class="sidebar"', f"<p>{_S * 2}</p>"), _not("form", "", f"<label>Name</label><p>{_S}</p><button>Send</button><select><option>One</option><option>Two</option></select>"),
        _not("section", 'id="comments" class="comments"', f"<h2>Comments</h2><article class='comment'><p>{_S}</p></article><ol><li class='comment'><p>{_S}</p></li></ol>"),
        _not("dialog", "", f"<p>{_S}</p>"), _not("menu", "", "<li>Cut</li><li>Paste</li>"), _not("button", "", "Press"),
        _not("ul", 'class="comments"', f"<li>{_S}</li>"), _not("fieldset", "", "<legend>Pick</legend>"),
        _not("address", "", "Street 1"), _not("textarea", "", "Write here")]
    frames = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
              '<div id="main" class="article body text">{}</div>', '<div id="wrapper" class="page container"><div class="post entry">{}</div></div>',
              '<section class="story">{}</section>', "<div>{}</div>", '<div class="page"><article class="post hentry">{}</article></div>']
    head = '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    pages = []
    for i, frame in enumerate(frames):
        n = len(boxes)
        for k in range(6):  # every box stands before, after or inside the article of some page
            pick = [boxes[(7 * i + 10 * k + j) % n] for j in range(10)]
            inside = frame.format(f"{pick[0]}{_BODY}{pick[1]}" if k % 2 else _BODY)
            pages.append(f"{head}{''.join(pick[2:6])}{inside}{''.join(pick[6:])}</body></html>")
    return pages


LABELLED = _labelled()
