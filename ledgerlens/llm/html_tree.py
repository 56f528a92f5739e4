"""Main-text extraction with a tree-structured graphical model.

The DOM is the graph: every element and every run of text is a node with a
binary state (content or not).  A node has a potential from its features (tag,
words of class, id and role, link density) and each edge a potential from
parent to child.  One upward and one downward pass of sum-product messages give
the exact marginals; runs of text with a content marginal of at least 1/2 are
kept.  The potentials are smoothed counts over labelled pages.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows

#: Pages of the table that the model learns from, at most (chosen by the hash of the id).
SAMPLE_PAGES = 512

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTAINERS = frozenset("html body nav aside header footer form".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag ends the open elements named here, up to the given limits.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "option": (("option",), ("select",)), "body": (("head",), ("html",))}
#: Elements whose tag says what they hold.  Others (p, li, div, h2, td ...) stand in content and elsewhere alike.
TELLING = frozenset("html head body article main nav aside header footer form button select input textarea label script style noscript "
                    "iframe dialog address hr template menu fieldset".split())
# Words of class, id and role attributes, by what they tell.
WORDS = {
    "comment": "comment comments commentlist reply replies discussion disqus respond responses feedback reactions guestbook",
    "side": "sidebar side aside rail widget widgets related recommended recommendations recommend popular trending more archive tags tagcloud",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip toolbar",
    "head": "header masthead topbar banner logo branding site-header",
    "foot": "footer foot bottom copyright colophon legal imprint",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter signup paywall message toast warning disclaimer",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion outbrain taboola dfp adsense commercial",
    "share": "share sharing social follow like tweet facebook",
    "form": "form search login signin register contact",
    "meta": "byline author meta date timestamp tag category",
    "content": "article content main post entry story body text prose copy maincontent articlebody",
}
FAMILY = {w: k for k, ws in WORDS.items() for w in ws.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_OPEN_END = re.compile(r"<(?:/?[a-zA-Z!?][^<]*)?\Z")


@dataclass
class Node:
    tag: str                     # "#text" for a run of text
    parent: int
    shape: tuple = ()            # families of its attributes
    text: str = ""
    label: str | None = None     # of a labelled page
    chars: int = 0
    linked: int = 0
    block: int = 0               # number of the block that a run of text belongs to


def _shape(attrs: str) -> tuple[tuple, str | None]:
    found, label = set(), None
    for name, a, b, c, bare in _ATTR.findall(attrs):
        name, value = (name or bare).lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-testid"):
            for w in [value, *_SPLIT.split(value)]:
                if w in FAMILY:
                    found.add(FAMILY[w])
            if value in ("complementary", "contentinfo", "navigation", "banner", "search"):
                found.add({"complementary": "side", "contentinfo": "foot", "navigation": "menu", "banner": "head", "search": "form"}[value])
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.add("hidden")
        elif name == "data-label":
            label = value
    return tuple(sorted(found)), label


def parse(page: str) -> list[Node]:
    """The DOM in page order (parents before children), with runs of text as leaves.

    End tags that HTML implies are supplied; an end tag without an open element
    is ignored; a tag that the page's end cuts off is dropped.
    """
    nodes = [Node("#root", -1)]
    stack = [0]
    block, at, n = 0, 0, len(page)
    cut = _OPEN_END.search(page, max(0, page.rfind("<")))
    shapes: dict[str, tuple] = {}

    def add_text(raw: str) -> None:
        if raw and not (raw.isspace() and nodes[-1].tag != "#text"):
            nodes.append(Node("#text", stack[-1], text=htmllib.unescape(raw) if "&" in raw else raw, block=block))

    def pop_to(depth: int) -> None:
        nonlocal block
        for i in stack[depth:]:
            if nodes[i].tag not in INLINE:
                block += 1
                break
        del stack[depth:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            tail = page[at:]
            if cut and cut.start() >= at:
                tail = page[at:cut.start()]
            add_text(tail)
            break
        if m.start() > at:
            add_text(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:                                                   # an end tag
            for d in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[d]].tag
                if open_tag == tag:
                    pop_to(d)
                    break
                if tag in INLINE and open_tag not in INLINE:       # an inline end tag closes nothing outside its block
                    break
            continue
        if tag in CLOSES_P:
            for d in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[d]].tag
                if open_tag == "p":
                    pop_to(d)
                    break
                if open_tag not in INLINE:
                    break
        if tag in IMPLIED:
            ends, limits = IMPLIED[tag]
            for d in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[d]].tag
                if open_tag in limits:
                    break
                if open_tag in ends:
                    pop_to(d)
                    break
        if tag == "br":
            nodes.append(Node("#text", stack[-1], text=" ", block=block))
            continue
        if tag not in INLINE:
            block += 1
        attrs = m[3]
        if attrs not in shapes:
            shapes[attrs] = _shape(attrs) if attrs.strip(" /") else ((), None)
        shape, label = shapes[attrs]
        nodes.append(Node(tag, stack[-1], shape, label=label))
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n                           # its text is no text of the page
            block += tag not in INLINE
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("path", "use")):
            stack.append(len(nodes) - 1)
    if not any(x.tag in ("article", "main") or "content" in x.shape and x.tag not in NOT_CONTAINERS for x in nodes):
        for x in nodes:                                            # no element is named as the container of the content
            if x.tag in ("#root", "html", "body"):
                x.shape = (*x.shape, "bare")
    return nodes


def _measure(nodes: list[Node]) -> None:
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        if x.tag == "#text":
            x.chars = len(x.text) - x.text.count(" ")
        elif x.tag == "a":
            x.linked = x.chars
        p = nodes[x.parent]
        p.chars += x.chars
        p.linked += x.linked


def _kind(x: Node) -> str:
    """Edges differ by what the child is: an element that says what it holds, a
    plain block, or a run of text (inline elements are parts of one)."""
    if x.shape or x.tag in TELLING:
        return "telling"
    return "text" if x.tag == "#text" or x.tag in INLINE else "block"


def _features(x: Node) -> tuple | None:
    if _kind(x) == "text":
        return None
    share = 4 * x.linked // x.chars if x.chars else 0
    return (x.tag if x.tag in TELLING else "", x.shape, min(share, 3) if x.chars > x.linked or not x.linked else 4)


@dataclass
class TreeModel:
    """Counts of the labelled pages, turned into smoothed potentials on use."""
    tags: Counter = field(default_factory=Counter)       # (telling tag, state)
    shapes: Counter = field(default_factory=Counter)     # (family, state)
    links: Counter = field(default_factory=Counter)      # (link density class, state), of plain blocks
    states: Counter = field(default_factory=Counter)     # (kind, state)
    edges: Counter = field(default_factory=Counter)      # (kind, parent's state, state)

    def learn(self, nodes: list[Node], states: list[int]) -> None:
        for i, x in enumerate(nodes[1:], 1):
            s, kind = states[i], _kind(x)
            self.edges[kind, states[x.parent], s] += 1
            if kind == "text":
                continue
            f = _features(x)
            self.states[kind, s] += 1
            if kind == "block":
                self.links[f[2], s] += 1
            if f[0]:
                self.tags[f[0], s] += 1
            for k in f[1]:
                self.shapes[k, s] += 1

    def add(self, table: str, key: str, n: int) -> None:
        parts = key.split("\x1f")
        getattr(self, table)[tuple(int(p) if p.isdigit() else p for p in parts)] += n

    def prepared(self) -> "Potentials":
        return Potentials(self)


class Potentials:
    """Potentials as ratios content : other, kept for each distinct feature tuple."""

    def __init__(self, m: TreeModel):
        self.m = m
        self.known: dict[tuple, float] = {}
        self.total = {(k, s): m.states[k, s] + 1.0 for k in ("telling", "block") for s in (0, 1)}
        self.edge = {}
        for kind, slip in (("text", 0.001), ("block", 0.2), ("telling", 1.0)):
            rows = {}
            for p in (0, 1):
                # a state is inherited unless the counts say otherwise
                same, other = m.edges[kind, p, p] + 20.0, m.edges[kind, p, 1 - p] + slip
                rows[p] = (same / (same + other), other / (same + other))
            self.edge[kind] = (rows[0][0], rows[0][1], rows[1][1], rows[1][0])      # t00, t01, t10, t11

    def node(self, f: tuple | None) -> float:
        if f is None:
            return 1.0
        r = self.known.get(f)
        if r is None:
            m, r = self.m, 1.0
            n1, n0 = self.total["telling", 1], self.total["telling", 0]
            if f[0] and m.tags[f[0], 1] + m.tags[f[0], 0]:
                r *= ((m.tags[f[0], 1] + 0.5) / n1) / ((m.tags[f[0], 0] + 0.5) / n0)
            for k in f[1]:
                r *= ((m.shapes[k, 1] + 0.2) / n1) / ((m.shapes[k, 0] + 0.2) / n0)
            if not f[0] and not f[1]:
                r *= ((m.links[f[2], 1] + 1.0) / self.total["block", 1]) / ((m.links[f[2], 0] + 1.0) / self.total["block", 0])
                r = min(2.0, max(0.2, r))                       # how linked a block is says a little only
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[f] = r
        return r


def marginals(nodes: list[Node], pot: Potentials) -> list[float]:
    """Content marginals by sum-product: messages upward to the root, then downward."""
    n = len(nodes)
    up = [pot.node(_features(x)) for x in nodes]
    up[0] = 20.0 if "bare" in nodes[0].shape else 0.05              # a page is not content as a whole, if it names what is
    sent = [1.0] * n
    edges = [pot.edge[_kind(x)] for x in nodes]
    for i in range(n - 1, 0, -1):
        t00, t01, t10, t11 = edges[i]
        r = up[i]
        sent[i] = m = (t11 * r + t10) / (t01 * r + t00)
        p = nodes[i].parent
        up[p] = min(1e200, max(1e-200, up[p] * m))
    belief = up[:]
    for i in range(1, n):
        t00, t01, t10, t11 = edges[i]
        cavity = belief[nodes[i].parent] / sent[i]
        belief[i] = min(1e200, max(1e-200, up[i] * (t11 * cavity + t01) / (t10 * cavity + t00)))
    return [b / (1 + b) for b in belief]


def blocks(nodes: list[Node], content: list[float]) -> list[str]:
    out: list[str] = []
    last, parts = -1, []
    for i, x in enumerate(nodes):
        if x.tag != "#text" or content[i] < 0.5:
            continue
        if x.block != last:
            out.append("".join(parts))
            last, parts = x.block, []
        parts.append(x.text)
    out.append("".join(parts))
    return [t for t in (" ".join(b.split()) for b in out) if t]


def extract(page: str | None, pot: Potentials) -> str:
    if not page:
        return ""
    nodes = parse(page)
    _measure(nodes)
    return "\n\n".join(blocks(nodes, marginals(nodes, pot)))


# Small labelled pages (data-label says which subtrees are content) of layouts that a crawl holds.
LABELLED = [
    """<body><header class="site-header"><a href="/">Home</a><h2>Site</h2></header><nav class="menu"><ul><li><a href="/a">A</a></li></ul></nav>
    <main data-label="1"><article><h1>Title</h1><p>Text of the story with <a href="/x">a link</a> in it.</p><h2>Part</h2><ul><li>point</li><li>point</li></ul>
    <blockquote><p>said</p></blockquote><aside class="related" data-label="0"><h3>Related</h3><a href="/r">other story</a></aside>
    <div class="ad" data-label="0">Buy now</div><table><tr><th>k</th><td>v</td></tr></table><pre>code</pre>
    <section class="comments" id="comments" data-label="0"><h3>Comments</h3><div class="comment"><p>First!</p></div><form><button>Send</button></form></section></article></main>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href="/p">p</a></li></ul><p>About this site.</p></aside>
    <div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><form class="search"><label>Search</label></form><footer><p>Copyright</p></footer></body>""",
    """<body><div id="header"><div class="logo">Site</div></div><div class="navbar"><a href="/1">One</a><a href="/2">Two</a></div>
    <div id="content" data-label="1"><h1>Title</h1><p>One.</p><p>Two.</p><div class="newsletter" data-label="0"><p>Subscribe to our letter</p><form><input></form></div>
    <p>Three.</p><div class="share" data-label="0"><a href="/s">Share</a></div><div class="advertisement" data-label="0"><p>Sponsored text</p></div><p>Four.</p>
    <figure><figcaption>A picture</figcaption></figure><dl><dt>t</dt><dd>d</dd></dl></div>
    <div id="sidebar"><div class="widget"><p>Tags</p><a href="/t">t</a></div></div><div id="comments"><ol class="commentlist"><li><p>A reply of a reader.</p></li></ol></div>
    <div id="footer"><p>All rights reserved</p></div></body>""",
    """<body><div class="notice" role="alert"><p>Notice of maintenance</p></div><section class="post" data-label="1"><h1>Title</h1><div class="entry"><p>Alpha.</p>
    <section><h2>More</h2><p>Beta.</p></section><nav class="toc" data-label="0"><a href="#a">Part A</a></nav><div class="promo" data-label="0">Try it</div>
    <p>Gamma <span>inline</span>.</p></div><footer class="tags" data-label="0"><a href="/t">tag</a></footer></section>
    <section id="disqus"><div class="reply"><p>I agree.</p></div></section><div class="popup modal"><p>Sign up</p></div></body>""",
    """<body><nav><a href="/">Start</a></nav><article data-label="1"><header><h1>Title</h1></header><p>Body text.</p><p>Body text.</p>
    <form data-label="0"><p>Vote</p></form><aside data-label="0"><p>Fact box of the site</p></aside><div><p>Nested text.</p></div></article>
    <article class="comment"><p>Comment of a reader</p></article><footer><nav><a href="/i">Imprint</a></nav><p>Address</p></footer></body>""",
    """<body data-label="1"><div class="header" data-label="0"><a href="/">Site</a></div><ul class="menu" data-label="0"><li><a href="/a">A</a></li></ul>
    <h1>Title</h1><p>Text.</p><div><p>More text.</p><ul><li>point</li></ul></div><aside data-label="0"><p>aside</p></aside>
    <div class="comments" data-label="0"><p>reader</p></div><form data-label="0"><p>form</p></form><footer data-label="0"><p>foot</p></footer></body>""",
]
#: Weight of a hand-labelled page against a page of the table.
LABELLED_WEIGHT = 24
#: What is never content, in pages labelled by structure.
_NEVER = frozenset("head nav aside form footer script style noscript template iframe button select input textarea label".split())
_NOT = frozenset("comment side menu head foot notice ad share form hidden".split())


def labelled_states(nodes: list[Node]) -> list[int]:
    """States of a hand-labelled page: a label holds for its subtree."""
    out = [0]
    for x in nodes[1:]:
        out.append(out[x.parent] if x.label is None else int(x.label))
    return out


def structural_states(nodes: list[Node]) -> list[int] | None:
    """States of a page whose markup names its article; None if it doesn't."""
    if not any(x.tag in ("article", "main") for x in nodes):
        return None
    out = [0]
    for x in nodes[1:]:
        if x.tag in _NEVER or _NOT.intersection(x.shape):
            out.append(-1)
        else:
            out.append(out[x.parent] if out[x.parent] else int(x.tag in ("article", "main")))
    return [max(s, 0) for s in out]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    """Counts from the hand-labelled pages and from at most ``sample_pages``
    pages of the table that are labelled by their own structure."""
    chosen = pages.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample_pages).distinct()
    rows = pages.select(F.col(id_col).alias("pid"), F.col(html_col).alias("html")).join(F.broadcast(chosen), F.col("pid") == F.col("id"))

    def count(batches):
        model = TreeModel()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page:
                    nodes = parse(page)
                    _measure(nodes)
                    states = structural_states(nodes)
                    if states:
                        model.learn(nodes, states)
        found = [(t, "\x1f".join(map(str, k)) if isinstance(k, tuple) else str(k), n)
                 for t in ("tags", "shapes", "links", "states", "edges") for k, n in getattr(model, t).items()]
        cols = list(zip(*found)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                                         names=["part", "key", "n"])

    counts = rows.select("html").mapInArrow(count, "part string, key string, n long").groupBy("part", "key").agg(F.sum("n").alias("n"))
    model = TreeModel()
    for r in counts.collect():                                      # tags, families and states of a bounded sample
        model.add(r["part"], r["key"], r["n"])
    for page in LABELLED:
        nodes = parse(page)
        _measure(nodes)
        for _ in range(LABELLED_WEIGHT):
            model.learn(nodes, labelled_states(nodes))
    return model


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Blocks of the main text in page order, joined by two line feeds; character
    references are decoded and white space inside a block is one space.  Null
    and empty pages, and pages without content, have an empty text.  Rows are
    independent: repeated rows give repeated results, null ids and urls stay
    null, an empty table gives no rows (the model then knows its hand-labelled
    pages only).  A worker holds one page and a bounded table of potentials.
    """
    model = train(pages, id_col, html_col, sample_pages)

    def make():
        pot = model.prepared()

        def row(page_id, url, page):
            text = extract(page, pot)
            return page_id, url, text, len(text)
        return row

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(src, make, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
