"""Operator 10: main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements and texts. Every node is content or not; its features
(tag, words of class, id and role, amount of text, share of it in links, place among
its siblings) give potentials of its own, and every parent-child edge has potentials by
the kind of the child. One upward and one downward pass of sum-product messages give each
node's exact marginal; the text nodes with a marginal of one half and more are kept.

The weights are trained by gradient ascent on the exact likelihood of labelled pages:
``LAYOUTS`` below, in which ``*`` marks what is content, with texts of different
lengths from a seeded generator. Nothing is learned from the pages to be extracted.

White space inside a block becomes one blank, blocks are trimmed and joined by line ends
in page order; block-level elements begin and end blocks, ``br`` is white space.
Character references are decoded. Scripts, styles, templates, forms' fields, comments
of the markup and the head are no text at all.

Defined results: null or empty html gives an empty text; unclosed and stray tags are
repaired as browsers do for paragraphs, list items and table cells; a page without tags
is one text; repeated rows get the same result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import bounded_batches

# Element names and words that page authors use.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg select button head".split())
VERBATIM = ("script", "style", "textarea", "title", "iframe")
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
SCOPES = set("ul ol dl table div section article aside main nav header footer form body".split())
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "top": "header masthead banner topbar logo brand",
    "bottom": "footer copyright legal colophon bottom",
    "side": "sidebar aside related widget recommended more popular trending rail teaser",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay subscribe newsletter paywall",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense",
    "share": "share social follow sharing buttons toolbar meta byline tags author",
    "reader": "comment comments reply replies discussion disqus respond feedback reviews",
    "form": "form search login signup contact",
    "main": "content article post entry story main body text page-content articlebody prose hentry",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
TAG_GROUPS = {
    "article": "article main", "nav": "nav menu", "aside": "aside", "header": "header", "footer": "footer",
    "form": "form fieldset label input legend", "title": "h1", "head": "h2 h3 h4 h5 h6", "para": "p pre blockquote",
    "item": "li dt dd", "list": "ul ol dl", "cell": "td th tr table tbody thead caption figcaption figure",
    "link": "a", "inline": "b i em strong span code small sub sup u mark q cite abbr time font", "box": "div section body html center",
    "dialog": "dialog details summary",
}
GROUP_OF = {t: g for g, tags in TAG_GROUPS.items() for t in tags.split()}
# a quote opens a value only after "=", elsewhere it is a character like others
MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:*][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Node:
    tag: str  # "" for a text
    parent: int
    text: str = ""
    hints: frozenset = frozenset()
    mark: bool = False
    blank: bool = False  # white space stood before it, after the node before
    children: list = field(default_factory=list)
    size: int = 0
    linked: int = 0
    stops: int = 0


def hints_of(attributes: str) -> tuple[frozenset, bool]:
    if not attributes.strip():
        return frozenset(), False
    found, mark = set(), False
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            value = next((v for v in values if v), "").lower()
            found |= {HINT_OF[w] for w in [*SPLIT.split(value), *value.split()] if w in HINT_OF}
        mark |= name == "data-main"
    return frozenset(found), mark


def tree(page: str) -> list[Node]:
    """Nodes in page order; node 0 is the root. Only visible parts are in it. A text of
    white space only is no node but marks the next one."""
    nodes, at, open_ = [Node("html", -1)], 0, [0]
    count = Counter()  # open elements by tag
    blank = False

    def add(node: Node) -> None:
        nonlocal blank
        node.blank, blank = blank, False
        nodes[node.parent].children.append(len(nodes))
        nodes.append(node)

    def add_text(raw: str) -> None:
        nonlocal blank
        if raw.strip():
            add(Node("", open_[-1], html.unescape(raw)))
        elif raw:
            blank = True

    def close(k: int) -> None:
        count.subtract(nodes[i].tag for i in open_[k:])
        del open_[k:]

    size = len(page)
    while at < size:
        found = MARKUP.search(page, at)
        if found is None:
            add_text(page[at:])
            break
        add_text(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if count[tag]:
                close(next(k for k in range(len(open_) - 1, 0, -1) if nodes[open_[k]].tag == tag))
            continue
        if tag in RAW and not found[3].endswith("/"):
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            if tag == "head":  # may be left unclosed before the body
                body = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = size if body is None else body.end() if body[0][1] == "/" else body.start()
            elif end:
                at = end.end()
            elif tag in VERBATIM:
                at = size
            continue
        ends = {*CLOSES.get(tag, ()), *(("p",) if tag in BLOCKS else ())}
        for k in range(len(open_) - 1, 0, -1) if any(count[t] for t in ends) else ():
            other = nodes[open_[k]].tag
            if other in ends:
                close(k)
                break
            if other in SCOPES:
                break
        hints, mark = hints_of(found[3])
        add(Node(tag, open_[-1], "", hints, mark))
        if tag not in VOID and not found[3].endswith("/"):
            open_.append(len(nodes) - 1)
            count[tag] += 1
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if not n.tag:
            n.size = len(n.text.split())
            n.stops = sum(n.text.count(c) for c in ".,!?")
        if n.tag == "a":
            n.linked = n.size
        if n.parent >= 0:
            p = nodes[n.parent]
            p.size += n.size
            p.linked += n.linked
            p.stops += n.stops
    return nodes


def _level(n: int) -> int:
    return 0 if n == 0 else min(5, 1 + int(math.log2(n) / 2))


def features(nodes: list[Node], i: int) -> list[str]:
    n = nodes[i]
    near = n if n.tag else nodes[n.parent]
    group = GROUP_OF.get(n.tag, "other") if n.tag else "text"
    links = 0 if not n.size else int(4 * (n.linked / n.size) + 0.5)
    out = [f"tag {group}", f"size {group == 'text'} {_level(n.size)}", f"links {links}"]
    out += [f"hint {h}" for h in n.hints]
    if not n.hints and n.tag:
        out.append("no hint")
    if not n.tag:
        out.append(f"in {GROUP_OF.get(near.tag, 'other')}")
        out.append(f"stops {min(3, n.stops)}")
    return out


def edge(nodes: list[Node], i: int) -> str:
    """Kind of the edge from a node to its parent."""
    if not nodes[i].tag:
        return "text"
    if nodes[i].hints - {"main"} or GROUP_OF.get(nodes[i].tag) in ("nav", "aside", "footer", "form", "header", "dialog"):
        return "apart"
    return GROUP_OF.get(nodes[i].tag, "other")


@dataclass
class Model:
    """Weight of content for every feature; per edge kind, the weights of (parent,
    child) states 00, 01, 10, 11."""

    own: dict[str, float] = field(default_factory=dict)
    edges: dict[str, list[float]] = field(default_factory=dict)


def _lse(a: float, b: float) -> float:
    m = a if a > b else b
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def marginals(model: Model, nodes: list[Node]):
    """(chance of content, log messages) by one pass up and one pass down the tree."""
    n = len(nodes)
    unary = [sum(model.own.get(f, 0.0) for f in features(nodes, i)) for i in range(n)]
    table = [model.edges.get(edge(nodes, i), (0.0, 0.0, 0.0, 0.0)) for i in range(n)]
    up0, up1 = [0.0] * n, list(unary)  # node with all below it
    to0, to1 = [0.0] * n, [0.0] * n  # message to the parent
    for i in range(n - 1, 0, -1):
        t = table[i]
        to0[i] = _lse(t[0] + up0[i], t[1] + up1[i])
        to1[i] = _lse(t[2] + up0[i], t[3] + up1[i])
        p = nodes[i].parent
        up0[p] += to0[i]
        up1[p] += to1[i]
    down0, down1 = [0.0] * n, [0.0] * n  # message from the parent
    for i in range(1, n):
        p, t = nodes[i].parent, table[i]
        rest0, rest1 = up0[p] + down0[p] - to0[i], up1[p] + down1[p] - to1[i]
        a, b = _lse(rest0 + t[0], rest1 + t[2]), _lse(rest0 + t[1], rest1 + t[3])
        m = a if a > b else b
        down0[i], down1[i] = a - m, b - m
    chance = []
    for i in range(n):
        x = max(-500.0, min(500.0, up0[i] + down0[i] - up1[i] - down1[i]))
        chance.append(1 / (1 + math.exp(x)))
    return chance, (up0, up1, to0, to1, down0, down1, table)


def _gradient(model: Model, nodes: list[Node], truth: list[int]):
    chance, (up0, up1, to0, to1, down0, down1, table) = marginals(model, nodes)
    own: dict[str, float] = {}
    edges: dict[str, list[float]] = {}
    for i, p in enumerate(chance):
        for f in features(nodes, i):
            own[f] = own.get(f, 0.0) + truth[i] - p
        if not i:
            continue
        a, t = nodes[i].parent, table[i]
        r0, r1 = up0[a] + down0[a] - to0[i], up1[a] + down1[a] - to1[i]
        logs = [r0 + t[0] + up0[i], r0 + t[1] + up1[i], r1 + t[2] + up0[i], r1 + t[3] + up1[i]]
        m = max(logs)
        total = sum(math.exp(x - m) for x in logs)
        g = edges.setdefault(edge(nodes, i), [0.0] * 4)
        for k, x in enumerate(logs):
            g[k] -= math.exp(x - m) / total
        g[2 * truth[a] + truth[i]] += 1
    return own, edges


def train(pages: list[str], rounds: int = 60) -> Model:
    """Batch gradient ascent (Adagrad) with a ridge; labels are ``data-main`` marks,
    which everything below them inherits."""
    data = []
    for page in pages:
        nodes = tree(page)
        truth = [0] * len(nodes)
        for i, n in enumerate(nodes):
            truth[i] = int(n.mark or n.parent >= 0 and truth[n.parent])
        for i in range(len(nodes) - 1, 0, -1):
            if truth[i]:  # what holds content is content, down to where it begins
                truth[nodes[i].parent] = 1
        data.append((nodes, truth))
    model, squares = Model(), {}
    for _ in range(rounds):
        for nodes, truth in data:
            own, edges = _gradient(model, nodes, truth)
            flat = [(model.own, f, None, g) for f, g in own.items()]
            for kind, gs in edges.items():
                model.edges.setdefault(kind, [0.0] * 4)
                flat += [(model.edges, kind, k, g) for k, g in enumerate(gs)]
            for store, name, k, g in flat:
                value = store.get(name, 0.0) if k is None else store[name][k]
                g -= 0.01 * value
                s = squares[name, k] = squares.get((name, k), 0.1) + g * g
                value += 0.3 * g / math.sqrt(s)
                if k is None:
                    store[name] = value
                else:
                    store[name][k] = value
    return model


# Labelled layouts. "*" before an attribute list marks content; {s} a sentence, {p} a
# paragraph, {w} a few words, {n} links in list items.
LAYOUTS = (
    "<nav><ul>{n}</ul></nav><div class=ad>{s}</div><article *><h1>{w}</h1><p>{p}</p><p><b>{w}<br><p>{p}</p></article>"
    "<footer>&copy; {w} &middot; {s}</footer>",
    "<nav><ul>{n}</ul></nav><div class='ad'>{w}</div><article *><h1>{s}</h1><p><b>{s}<br><p>{w}</p><p>{p}</p></article>"
    "<footer>{w}</footer>",
    "<header><h1>{w}</h1><nav>{n}</nav></header><main *><h1>{w}</h1><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul><p>{p}</p>"
    "</main><aside><h2>{w}</h2><p>{s}</p><ul>{n}</ul></aside><footer><p>{s}</p>{n}</footer>",
    "<div class=header><a href=/>{w}</a><p>{w}</p></div><div class='menu'><ul>{n}</ul></div><div class='post-content' *>"
    "<h2>{w}</h2><p>{p}</p><blockquote>{p}</blockquote><p>{p} <a href=x>{w}</a> {s}</p></div><div class=comments><h3>{w}</h3>"
    "<div class=comment><p>{p}</p></div><div class=comment><p>{s}</p></div></div><div class=footer>{s}</div>",
    "<div id='cookie-notice'><p>{s}</p><button>{w}</button></div><div id=page><div id=sidebar><p>{s}</p><ul>{n}</ul></div>"
    "<div id=content *><h1>{w}</h1><p>{p}</p><table><tr><td>{w}</td><td>{w}</td></tr></table><p>{s}</p></div></div>"
    "<form><label>{w}</label><input name=q><p>{s}</p></form><footer>{w}</footer>",
    "<div class=banner-ad><p>{s}</p></div><article *><header><h1>{w}</h1></header><section><h2>{w}</h2><p>{p}</p></section>"
    "<section><p>{s}</p><pre>{w}</pre></section></article><section class='comments'><p>{p}</p><p>{s}</p></section>",
    "<aside class=newsletter><p>{s}</p><form><input><label>{w}</label></form></aside><div class='entry' *><p>{p}</p>"
    "<p>{p}</p><p>{w}</p></div><div class='related'><h3>{w}</h3><ul>{n}</ul></div><div class='share'><a href=x>{w}</a></div>",
    "<div><ul>{n}</ul></div><div *><p>{p}</p><p>{p}</p><p>{p}</p></div><div>{w}</div>",
    "<div class=nav>{n}</div><div *><div><p>{p}</p></div><div><p>{p}</p><p>{s}</p></div></div><div class=copyright>{s}</div>",
    "<p *>{p}</p><p *>{s}</p>",
    "<h1 *>{w}</h1><p *>{s}</p><hr><p *>{p}</p>",
    "<section class='alert'>{s}</section><div class=article *><h1>{w}</h1>{p}<br><br>{p}<div>{s}</div></div>"
    "<div class='sponsored'><p>{s}</p><p>{s}</p></div><div id=disqus><p>{p}</p></div>",
)
SYLLABLES = "ta ne ri so lu ma ke di po va en or st al".split()


def labelled_pages(copies: int = 6, seed: int = 10) -> list[str]:
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        n = rng.randint(lo, hi)
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))

    def sentence() -> str:
        return f"{words(3, 14).capitalize()}, {words(1, 8)}."

    makers = {
        "{w}": lambda: words(1, 4),
        "{s}": sentence,
        "{p}": lambda: " ".join(sentence() for _ in range(rng.choice((1, 2, 3, 5, 9, 20)))),
        "{n}": lambda: "".join(f"<li><a href=x>{words(1, 2)}</a></li>" for _ in range(rng.randint(2, 8))),
    }
    out = []
    for _ in range(copies):
        for layout in LAYOUTS:
            page = re.sub(r"\{[wspn]\}", lambda m: makers[m[0]](), layout).replace(" *>", " data-main>")
            out.append(f"<html><head><title>{words(2, 5)}</title></head><body>{page}</body></html>")
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages())


def extract(page: str, model: Model) -> str:
    nodes = tree(page)
    if len(nodes) == 1:
        return ""
    chance, _ = marginals(model, nodes)
    plain = not any(n.tag for n in nodes[1:])
    blocks: list[list[str]] = [[]]
    # page order with the ends of elements: a walk with an explicit stack
    stack: list[tuple[int, bool]] = [(0, False)]
    while stack:
        i, leaving = stack.pop()
        n = nodes[i]
        if n.blank and not leaving:
            blocks[-1].append(" ")
        if not n.tag:
            if plain or chance[i] >= 0.5:
                blocks[-1].append(n.text)
            elif n.text != n.text.strip():
                blocks[-1].append(" ")
            continue
        if n.tag == "br":
            blocks[-1].append(" ")
        if n.tag in BLOCKS and blocks[-1]:
            blocks.append([])
        if not leaving:
            stack.append((i, True))
            stack.extend((c, False) for c in reversed(n.children))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    model = model or trained()

    def extracted(batches):
        for batch in batches:
            texts = [extract(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(extracted, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
