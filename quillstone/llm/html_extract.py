"""HTML extraction: gradient-boosted trees over DOM-node features, with hierarchical decoding.

A page is read into a tree of elements; each gets features of its tag, its class and id tokens, its depth, place and
siblings, and of its subtree: text, links and tags, and their densities. Boosted trees, trained here on pages that a
seeded generator writes with known labels, give each element the log-odds that it belongs to the main text. Decoding goes
down the tree: an element is kept or dropped with its whole subtree unless its children can do better, and whatever stands
in a dropped element is dropped, so no descendant contradicts an ancestor.

Pages are read by a scanner that moves forward only, so time grows with the length of a page, however broken it is; no
step recurses, so a page may be nested as deep as it likes.

Defined results: a null or empty page has an empty text and 0 code points; so has one without main text. As in browsers,
head ends at the first element that is no head content, an open paragraph, list item, cell or heading at the next one, an
end tag closes no element outside of its table cell, attribute values may stand without quotes and hold some, and a tag or
comment that the page's end cuts off is no text. Scripts, buttons and other elements that show no text of the page don't
split the block around them; elements of unknown names are blocks. Character references are decoded in each stretch of
text between tags. Pages are read whole, repeated rows each. An empty table gives an empty result. Columns besides
page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, with_code

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no text of the page; they stand in a block without splitting it.
SILENT = frozenset("script style noscript template head title iframe object svg canvas select option textarea button noembed noframes datalist".split())
#: Nothing in them is a tag but their own end.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var video wbr".split())
#: Elements that head may hold.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section table ul".split())
#: Opening the key ends an open element of the set, up to the nearest of the scope.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table", "td", "th")), "dt": (("dt", "dd"), ("dl", "table", "td", "th")), "dd": (("dt", "dd"), ("dl", "table", "td", "th")), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr"), ("table",)),
    "option": (("option",), ("select",)),
}
#: End tags close nothing outside of these, but for the parts of a table, which reach up to the table.
WALLS = ("table", "td", "th", "caption", "template", "object")
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "li", "table", "blockquote", "pre", "figure", "nav", "header", "footer", "aside", "form", "body")
#: Tokens of class, id and role by what they speak for.
GOOD = frozenset("article body content copy entry main page post prose story text".split())
BAD_GROUPS = tuple(
    frozenset(x.split())
    for x in (
        "ad ads advert advertisement banner promo sponsor sponsored",
        "nav navbar navigation menu breadcrumb breadcrumbs pagination pager links toolbar tabs",
        "sidebar side aside related widget recommended rail more popular trending",
        "comment comments reply replies discussion respond disqus reader readers",
        "footer foot copyright legal bottom colophon",
        "header masthead top head brand logo",
        "cookie cookies consent notice alert popup modal overlay gdpr banner privacy subscribe newsletter signup login search form",
        "share social meta tags byline author date breadcrumb rating",
    )
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes as they mostly are, up to the end of the tag.
_PLAIN = re.compile(r"""(?>(?:\s++[^\s"'>/=]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+)\s*+/?+>""")
_NAMED = re.compile(r"""\s(class|id|role)=(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?+(\s*+=\s*+)?+")
_COMMENT_END = re.compile("--!?>")
_UNQUOTED = re.compile(r"[^\s>]*+")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "tokens", "parent", "depth", "parts", "size", "links", "tags", "at", "sibling", "children", "marks")

    def __init__(self, tag: str, tokens: frozenset, parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.depth = parent.depth + 1 if parent else 0
        #: Text pieces and elements in page order.
        self.parts: list = []
        self.children: list[Node] = []
        self.size = self.links = self.tags = self.at = self.sibling = self.marks = 0


def words_of(value: str) -> list[str]:
    return _WORD.findall(value.lower())


def attributes(html: str, at: int) -> tuple[int, frozenset]:
    """(place behind the tag whose name ends here, tokens of its class, id and role); -1 if the page ends in it."""
    plain = _PLAIN.match(html, at)
    if plain:
        own = html[at : plain.end()]
        return plain.end(), frozenset(w for m in _NAMED.finditer(own) for w in words_of(m[2] or m[3] or m[4] or "")) if "=" in own else frozenset()
    found: list[str] = []
    while True:
        one = _ATTRIBUTE.match(html, at)
        at = one.end()
        if at >= len(html):
            return -1, frozenset()
        if one[2] is not None and one[1]:
            quote = html[at]
            if quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    return -1, frozenset()
                value, at = html[at + 1 : end], end + 1
            else:
                value = _UNQUOTED.match(html, at)[0]
                at += len(value)
            if one[1].lower() in ("class", "id", "role"):
                found += words_of(value)
        if at < len(html) and html[at] == ">":
            return at + 1, frozenset(found)


class Open:
    """The elements that are open: where each tag stands innermost is known, so that no lookup walks up."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """The element at this place, and what is open in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


def parse(html: str) -> Node:
    """The tree of elements that aren't inline; inline ones give their text, and the length of links, to their block."""
    root = Node("html", frozenset(), None)
    open_, at, end, links, begun = Open(root), 0, len(html), 0, False

    def add(text: str) -> None:
        if text:
            node = open_.nodes[-1]
            if node.tag == "head" and not text.isspace():
                open_.close(len(open_.nodes) - 1)
                node = open_.nodes[-1]
            text = entities.unescape(text) if "&" in text else text
            node.parts.append(text)
            if links:
                node.links += len(text)

    while at < end:
        tag = html.find("<", at)
        if tag < 0:
            add(html[at:])
            break
        add(html[at:tag])
        at, closing = tag + 1, html.startswith("/", tag + 1)
        name = _NAME.match(html, at + closing)
        if not name:
            if html.startswith("!--", at):
                empty = 4 if html.startswith(">", at + 3) else 5 if html.startswith("->", at + 3) else 0
                stop = _COMMENT_END.search(html, at + 3)
                at = at + empty if empty else stop.end() if stop else end
            elif (closing and at + 1 < end) or html.startswith(("!", "?"), at):
                stop = html.find(">", at)
                at = end if stop < 0 else stop + 1
            else:
                add("<")
            continue
        at, tokens = attributes(html, name.end())
        if at < 0:
            break
        name, node = name[0].lower(), open_.nodes[-1]
        if closing:
            if name == "a":
                links = 0
            if name == "br":
                add(" ")
            if name not in INLINE:
                place = open_.places.get(name)
                if place and place[-1] >= open_.last(("table",) if name in TABLE_PARTS else WALLS):
                    open_.close(place[-1])
                    links = 0
            continue
        if node.tag == "head" and name not in HEAD:
            open_.close(len(open_.nodes) - 1)
            node = open_.nodes[-1]
        if name == "br":
            add(" ")
        if name == "a":
            links = 1
        if name in INLINE or (name in VOID and name != "hr"):
            node.tags += 1
            continue
        if name in ("html", "body") and (name == "html" or begun):
            root.tokens |= tokens
            continue
        if name == "body":
            root.tokens |= tokens
            begun = True
        if name in ENDS_P and node.tag == "p":
            open_.close(len(open_.nodes) - 1)
            links = 0
        if name in HEADINGS and open_.nodes[-1].tag in HEADINGS:
            open_.close(len(open_.nodes) - 1)
        if name in ENDS:
            ends, scope = ENDS[name]
            # The outermost of them in the scope.
            wall = open_.last(scope)
            inside = [p for t in ends for p in open_.places.get(t, [])[-1:] if p > wall]
            if inside:
                open_.close(min(inside))
        node = open_.nodes[-1]
        child = Node(name, tokens, node)
        if name in SILENT:
            node.tags += 1  # what it holds is never reached from its parent
        else:
            node.parts.append(child)
            node.children.append(child)
        if name == "hr" or (name in ("svg", "math") and html[at - 2] == "/"):
            continue
        open_.push(child)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = close.start() if close else end
    return root


def block_text(pieces: list[str]) -> str:
    return _SPACE.sub(" ", "".join(pieces)).strip()


def blocks(root: Node, kept) -> Iterator[str]:
    """The text blocks of the nodes that are kept, in page order."""
    run: list[str] = []
    open_ = [(root, iter(root.parts))]
    while open_:
        node, parts = open_[-1]
        part = next(parts, None)
        if isinstance(part, str):
            run.append(part)
            continue
        if run and kept(node) and (text := block_text(run)):
            yield text
        run = []
        if part is None:
            open_.pop()
        else:
            open_.append((part, iter(part.parts)))


def all_nodes(root: Node) -> list[Node]:
    """Parents before children; sets what features need."""
    out = [root]
    for node in out:
        for i, child in enumerate(node.children):
            child.at, child.sibling = i, len(node.children)
            out.append(child)
    for node in reversed(out):
        own = [p for p in node.parts if isinstance(p, str)]
        node.size += sum(len(p.strip()) for p in own)
        node.marks += sum(p.count(".") + p.count(",") for p in own)
        if node.parent:
            up = node.parent
            up.size, up.links, up.tags, up.marks = up.size + node.size, up.links + node.links, up.tags + node.tags + 1, up.marks + node.marks
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node."""
    total, rows, chain = max(1, nodes[0].size), [], {}
    alike = {id(node): Counter(c.tag for c in node.children) for node in nodes if node.children}
    for i, node in enumerate(nodes):
        up = node.parent
        own = [bool(node.tokens & g) for g in BAD_GROUPS]
        good = bool(node.tokens & GOOD)
        boiler = (node.tag in ("nav", "header", "footer", "aside", "form")) + sum(own) > 0
        # What stands above: any boilerplate, any article, any good token, and the least share of the page's text in a boilerplate element.
        above = chain[id(up)] if up else (False, False, False, 1.0)
        chain[id(node)] = (above[0] or boiler, above[1] or node.tag in ("article", "main"), above[2] or good, min(above[3], node.size / total) if boiler else above[3])
        text = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        rows.append(
            (
                node.depth, node.at, node.sibling, node.at / max(1, node.sibling - 1) if node.sibling > 1 else 0.0,
                np.log1p(node.size), node.size / total, np.log1p(text), node.links / max(1, node.size), node.tags, node.size / (1 + node.tags), node.marks / max(1, node.size),
                up.size / total if up else 1.0, up.links / max(1, up.size) if up else 0.0, node.size / max(1, up.size) if up else 1.0,
                alike[id(up)][node.tag] / len(up.children) if up else 1.0,
                i / len(nodes), *above, good, *own, boiler,
                *(node.tag == t for t in TAGS), *((up.tag if up else "") == t for t in TAGS),
            )
        )
    return np.array(rows, np.float32)


class Boosted:
    """Gradient-boosted trees with logistic loss, grown level by level on histograms of quantile bins."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        marks = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, marks)) for c in x.T]
        codes, score, count = self.binned(x).astype(np.int64), np.zeros(len(y)), 1 << self.depth
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            feature, split, at = np.zeros(count, np.int64), np.full(count, self.bins, np.int64), np.ones(len(y), np.int64)
            for level in range(self.depth):
                first = 1 << level
                best = np.full(first, 1e-6)
                for f in range(x.shape[1]):
                    cell = (at - first) * self.bins + codes[:, f]
                    g = np.bincount(cell, gradient, first * self.bins).reshape(first, self.bins).cumsum(axis=1)
                    h = np.bincount(cell, weight, first * self.bins).reshape(first, self.bins).cumsum(axis=1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                    gain[(h < self.least) | (h_all - h < self.least)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(first), k]
                    better = top > best
                    best[better] = top[better]
                    feature[first : 2 * first][better], split[first : 2 * first][better] = f, k[better]
                at = 2 * at + (codes[np.arange(len(y)), feature[at]] > split[at])
            leaf = at - count
            value = self.rate * np.bincount(leaf, gradient, count) / (np.bincount(leaf, weight, count) + 1)
            self.nodes.append((feature, split, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        codes, out, rows = self.binned(x), np.zeros(len(x)), np.arange(len(x))
        for feature, split, value in self.nodes:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (codes[rows, feature[at]] > split[at])
            out += value[at - len(value)]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """The nodes kept, by id. A subtree that is dropped costs the odds of all its text; one that is kept open gains the node's own and its children's best."""
    gain: dict[int, float] = {}
    kept_if_open: dict[int, bool] = {}
    for node, odd in zip(reversed(nodes), odds[::-1], strict=True):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        here = float(odd) * np.log1p(own) if own else 0.0
        below = sum(max(0.0, gain[id(c)]) for c in node.children)
        # An element that looks like boilerplate has to be paid for by what stands in it.
        gain[id(node)] = here + below + (float(odd) if own == 0 and odd < 0 else 0.0)
        kept_if_open[id(node)] = here > 0
    kept, open_ = set(), [nodes[0]]
    while open_:
        node = open_.pop()
        if kept_if_open[id(node)]:
            kept.add(id(node))
        open_ += [c for c in node.children if gain[id(c)] > 0]
    return kept


class Pages:
    """Seeded pages with labels: the ids of nodes whose own text is main text follow from a mark in their text."""

    MARK = "\x07"

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice("aeioustrnlmdpké") for _ in range(self.rng.randint(1, 9)))

    def text(self, least: int, most: int) -> str:
        words = [self.word() + self.rng.choice(["", "", "", "", "", ",", "."]) for _ in range(self.rng.randint(least, most))]
        return " ".join(words)

    def links(self, n: int) -> str:
        item = lambda: f'<a href="/{self.word()}">{self.text(1, 3)}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if self.rng.random() < 0.7 else " ".join(item() for _ in range(n))

    def element(self, tag: str, names: str, inner: str) -> str:
        r = self.rng.random()
        name = self.rng.choice(names.split()) if names else ""
        name += self.rng.choice(["", "", "-box", "-wrapper", "-1"]) if name else ""
        attributes = "" if not name or r < 0.15 else f' class="{name}"' if r < 0.7 else f' id="{name}"'
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def paragraph(self, main: bool) -> str:
        mark = self.MARK if main else ""
        inner = mark + self.text(3, 60)
        if self.rng.random() < 0.2:
            inner += f' <a href="/x">{self.text(1, 3)}</a> {self.text(1, 20)}'
        if self.rng.random() < 0.1:
            inner = f"<b>{inner}<br>"
        return f"<p>{inner}" + ("</p>" if self.rng.random() < 0.9 else "")

    def boiler(self) -> str:
        r, e = self.rng, self.element
        return r.choice([
            lambda: e("nav", "menu nav navigation breadcrumb", self.links(r.randint(2, 9))),
            lambda: e("div", "menu nav navbar navigation breadcrumbs", self.links(r.randint(2, 9))) if r.random() < 0.5 else f'<div class="menu">{self.links(4)}</div>',
            lambda: e("header", "header masthead top", f"<h1>{self.text(1, 4)}</h1>" * (r.random() < 0.4) + f"<p>{self.text(2, 9)}</p>" * (r.random() < 0.5) + self.links(r.randint(1, 5))),
            lambda: f'<div class="{r.choice(["header", "masthead", "site-header", "top-bar"])}">{self.text(1, 8)}{self.links(2)}</div>',
            lambda: e("footer", "footer", "&copy; " + self.text(2, 20)),
            lambda: f'<div class="{r.choice(["footer", "site-footer", "copyright", "legal"])}"><p>{self.text(2, 30)}</p></div>',
            lambda: e("aside", "sidebar related widget", f"<h3>{self.text(1, 4)}</h3><p>{self.text(5, 40)}</p>" * r.randint(0, 3) + self.links(3)),
            lambda: f'<div class="{r.choice(["sidebar", "related", "side", "widget", "recommended"])}"><h2>{self.text(1, 4)}</h2>' + f"<p>{self.text(5, 40)}</p>" * r.randint(0, 3) + self.links(3) + "</div>",
            lambda: f'<div class="{r.choice(["ad", "ads", "advert", "banner", "promo", "sponsored"])}">' + r.choice(["{}", "<p>{}</p>"]).format(self.text(3, 30)) + "</div>",
            lambda: f'<{(t := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="{r.choice(["cookie-notice", "cookie", "notice", "consent", "alert", "popup", "newsletter", "gdpr"])}">' + r.choice(["{}", "<p>{}</p>"]).format(self.text(4, 40)) + f"<button>{self.text(1, 2)}</button></{t}>",
            lambda: f'<form{r.choice(["", " class=search", " class=newsletter", " id=login"])}><label>{self.text(1, 4)}</label><p>{self.text(2, 20)}</p><input type=text><button>{self.text(1, 2)}</button></form>',
            lambda: self.comments(),
            lambda: f'<{(t := r.choice(["p", "div"]))} {r.choice(["class", "id"])}="{r.choice(["ad", "notice", "copyright", "share", "byline-meta", "promo", "cookie-note", "related"])}">{self.text(2, 25)}</{t}>' if r.random() < 0.9 else f'<div role="{r.choice(["navigation", "banner", "alert", "search", "complementary", "contentinfo"])}">{self.text(2, 20)}{self.links(2)}</div>',
            lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["sidebar", "footer", "header", "comments", "related"])}"><div>' + f"<p>{self.text(3, 40)}</p>" * r.randint(1, 4) + "</div></div>",
            lambda: f'<ul class="{r.choice(["menu", "nav", "breadcrumb", "pagination", "social"])}">' + "".join(f"<li><a href=/>{self.text(1, 3)}</a></li>" for _ in range(r.randint(2, 7))) + "</ul>",
            lambda: f'<div class="{r.choice(["share", "social", "tags", "meta", "byline"])}">{self.text(1, 6)}{self.links(2)}</div>',
        ])()

    def comments(self) -> str:
        r = self.rng
        tag, name = r.choice(["div", "section", "aside"]), r.choice(["comments", "comment-list", "replies", "discussion", "reader-comments"])
        one = lambda: r.choice([f'<div class="comment"><p>{self.text(5, 40)}</p></div>', f"<p>{self.text(5, 40)}</p>", f"<li><p>{self.text(4, 40)}</p></li>", f"<article class=\"comment\"><p>{self.text(5, 40)}</p></article>"])
        return f'<{tag} {r.choice(["class", "id"])}="{name}"><h3>{self.text(1, 3)}</h3>' + "".join(one() for _ in range(r.randint(1, 6))) + f"</{tag}>"

    def main(self) -> str:
        r, m = self.rng, self.MARK
        parts = [f"<h1>{m}{self.text(1, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            parts.append(self.paragraph(True))
            x = r.random()
            if x < 0.08:
                parts.append(f"<h2>{m}{self.text(1, 7)}</h2>")
            elif x < 0.14:
                parts.append("<ul>" + "".join(f"<li>{m}{self.text(2, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.18:
                parts.append(f"<blockquote>{r.choice(['{}', '<p>{}</p>']).format(m + self.text(4, 40))}</blockquote>")
            elif x < 0.2:
                parts.append(f"<pre>{m}{self.text(4, 20)}</pre>")
            elif x < 0.22:
                parts.append("<table>" + "".join(f"<tr><td>{m}{self.text(1, 4)}</td><td>{m}{self.text(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.3:
                parts.append(r.choice([self.boiler, self.boiler, self.comments])())
        if not parts:
            parts = [self.paragraph(True)]
        if r.random() < 0.06:
            parts.insert(0, f'<div class="{r.choice(["header", "page-header", "head", "title-top"])}"><h1>{m}{self.text(1, 10)}</h1></div>')
        inner = "".join(parts)
        if r.random() < 0.14:
            return self.misnamed(inner)
        if r.random() < 0.2:
            inner = f"<div>{inner}</div>"
        kind = r.random()
        if kind < 0.06:
            return inner
        if kind < 0.1:
            return f"<main><div class=row><article>{inner}</article></div></main>"
        if kind < 0.5:
            return f"<article{r.choice(['', '', ' class=post', ' class=entry'])}>{inner}</article>"
        if kind < 0.7:
            return f"<main>{inner}</main>"
        return self.element(r.choice(["div", "div", "section"]), "content main post article entry story article-body post-content main-content text", inner)

    def misnamed(self, inner: str) -> str:
        """A main element with a word of boilerplate among its names, as in 'ad-free' or 'cookie-recipe'."""
        r = self.rng
        bad = r.choice(sorted(r.choice(BAD_GROUPS)))
        name = r.choice([f"{bad}-{self.word()}", f"{self.word()}-{bad}", f"{bad}-free content", f"{bad} post", bad])
        tag = r.choice(["article", "main", "article", "main", "div", "section"])
        if tag in ("div", "section"):
            name = f"{bad}-{r.choice(['content', 'article', 'story', 'post', 'text'])}"
            inner = f"<h1>{self.MARK}{self.text(2, 9)}</h1>{self.paragraph(True)}{inner}"
        return f'<{tag} {r.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    def page(self) -> str:
        r = self.rng
        before, after = [self.boiler() for _ in range(r.randint(0, 4))], [self.boiler() for _ in range(r.randint(0, 4))]
        inner = "".join([*before, f"<!-- {self.word()} -->", self.main(), *after])
        if r.random() < 0.3:
            inner = f"<div{r.choice(['', ' id=page', ' class=wrapper', ' class=container'])}>{inner}</div>"
        if r.random() < 0.1:
            # As some servers write pages: a form around all.
            inner = f"<form{r.choice(['', ' id=aspnetForm', ' id=form1 class=page', ' class=main-form'])}>{inner}</form>"
        return f"<!DOCTYPE html><html><head><title>{self.text(1, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{inner}" + ("</body></html>" if r.random() < 0.9 else "")

    def labelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Features and labels of a page's nodes: main text in them, and no less of it than of other text."""
        nodes = all_nodes(parse(self.page()))
        mine: dict[int, int] = {}
        for node in reversed(nodes):
            own = sum(len(p.strip()) for p in node.parts if isinstance(p, str) )
            has = any(self.MARK in p for p in node.parts if isinstance(p, str))
            mine[id(node)] = (own if has else 0) + sum(mine[id(c)] for c in node.children)
        return features(nodes), np.array([2 * mine[id(n)] > n.size for n in nodes], np.float64)


@lru_cache(2)
def trained(pages: int = 1000, seed: int = 7) -> Boosted:
    made = Pages(seed)
    x, y = zip(*(made.labelled() for _ in range(pages)), strict=True)
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [all_nodes(parse(p or "")) for p in pages]
    if not trees:
        return []
    odds = model.score(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for nodes in trees:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(blocks(nodes[0], lambda n, kept=kept: id(n) in kept)))
    return out


def extract(pages: DataFrame, model: Boosted | None = None, at_once: int = 200) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    with_code(spark)
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
