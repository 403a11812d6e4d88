"""Main text of web pages, by a tree-structured graphical model over the page's elements.

Every element and every block of text of a page is a node with a hidden state: it is (or holds) main text, or
not. A node's state depends on its parent's and on its tag; what is seen at a node (words of its class and id, length,
share of links, end of sentence) depends on its state. All tables are counted on labelled pages.
Sum-product messages pass up the tree and down again; blocks whose marginal is above one half are the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm import labelled
from flowtide.llm.common import whole

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title template noscript iframe object svg math canvas audio video select textarea datalist".split())
#: what may stand in a head; any other start tag, or text, ends a head that is left open
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

TEXT = "#text"
#: weight of what is seen at a block of text: neighbouring blocks are alike, and their evidence is not independent
BLOCK_WEIGHT = 0.3
#: how many counts the coarser table is worth in a finer one
PRIOR = 5.0
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Node:
    tag: str
    parent: int
    seen: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    text: str = ""


class Page(HTMLParser):
    """The tree of a page. Nodes stand in page order, a parent before its children; the nodes with tag
    ``#text`` are blocks of running text and have no children. Inline elements are no nodes."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1)]
        #: open elements: (tag, node or -1 for inline ones)
        self.stack: list[tuple[str, int]] = []
        self.opened: Counter = Counter()
        self.holders = [0]
        self.silent = self.links = 0
        #: a page has one head, before its body
        self.headed = False
        self.block = -1
        self.feed(html)
        self.close()
        self._end_block()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "head" and self.headed:
            return
        self.headed |= tag in ("head", "body")
        if self.opened["head"] and (tag == "body" and not self.opened["template"] or self.stack[-1][0] == "head" and tag not in IN_HEAD):
            self._close("head", ())
        if tag in VOID:
            if tag in ("br", "hr"):
                self._space() if tag == "br" else self._end_block()
            return
        if tag not in INLINE and self.opened["p"]:
            self._close("p", ())
        for other in CLOSES.get(tag, ()):
            if self.opened[other]:
                self._close(other, SCOPES.get(tag, ()))
        node = -1
        if tag in SILENT:
            self.silent += 1
        elif tag == "a":
            self.links += 1
        elif tag not in INLINE:
            self._end_block()
            node = len(self.nodes)
            self.nodes.append(Node(tag, self.holders[-1], _names(attrs)))
            self.holders.append(node)
        self.stack.append((tag, node))
        self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.opened[tag]:
            self._close(tag, ())
        elif tag == "br":
            self._space()

    def _close(self, tag: str, scope: tuple[str, ...]) -> None:
        """Close the innermost open ``tag`` and what is open inside it, unless a tag of ``scope`` is between."""
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            if self.stack[at][0] in scope:
                return
            at -= 1
        while len(self.stack) > at:
            name, node = self.stack.pop()
            self.opened[name] -= 1
            if name in SILENT:
                self.silent -= 1
            elif name == "a":
                self.links -= 1
            elif node >= 0:
                self._end_block()
                self.holders.pop()

    def _space(self) -> None:
        if self.block >= 0:
            self.nodes[self.block].parts.append(" ")

    def handle_data(self, data: str) -> None:
        if self.silent and self.stack[-1][0] == "head" and not data.isspace():
            self._close("head", ())
        if self.silent:
            return
        if self.block < 0:
            if not data or data.isspace():
                return
            self.block = len(self.nodes)
            self.nodes.append(Node(TEXT, self.holders[-1]))
        node = self.nodes[self.block]
        node.parts.append(data)
        size = len(data)
        node.chars += size
        if self.links:
            node.linked += size

    def _end_block(self) -> None:
        if self.block >= 0:
            node = self.nodes[self.block]
            node.text = " ".join("".join(node.parts).split())
            node.parts = []
            self.block = -1


def _names(attrs: list[tuple[str, str | None]]) -> list[str]:
    """Words of class, id and role; a mark for hidden elements."""
    out = []
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            out += [w.lower() for w in _NAME.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", ""):
            out.append("#hidden")
    return list(dict.fromkeys(out))


def _share(linked: int, chars: int) -> str:
    share = linked / chars if chars else 0.0
    return "none" if not linked else "some" if share < 0.35 else "many" if share < 0.8 else "all"


def observe(nodes: list[Node]) -> list[list[str]]:
    """What is seen at each node."""
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for i, n in enumerate(nodes):
        if n.tag == TEXT:
            size = n.text.count(" ") + 1
            long = "1" if size < 3 else "2" if size < 7 else "3" if size < 20 else "4" if size < 50 else "5"
            seen = [f"size {long}", f"links {_share(n.linked, n.chars)}", f"sentence {n.text[-1:] in '.!?:\"”»'}"]
            if "©" in n.text:
                seen.append("copyright")
        else:
            seen = [*n.seen, f"inside {_share(linked[i], chars[i])}"]
        out.append(seen)
    return out


@dataclass
class Model:
    """Log tables with an entry for either state: ``move[parent's tag, tag, parent's state]``, by tag alone
    under the parent's tag "", ``anywhere[parent's state]``; ``shown[what]`` for what is seen."""

    move: dict[tuple[str, str, int], tuple[float, float]]
    anywhere: tuple[tuple[float, float], tuple[float, float]]
    shown: dict[str, tuple[float, float]]

    def _moves(self, parent: str, tag: str) -> tuple[tuple[float, float], ...]:
        get = self.move.get
        return tuple(get((parent, tag, s)) or get(("", tag, s)) or self.anywhere[s] for s in (0, 1))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of being or holding content, for every node."""
        n = len(nodes)
        none = (0.0, 0.0)
        here0, here1 = [0.0] * n, [0.0] * n
        for i, seen in enumerate(observe(nodes)):
            weight = BLOCK_WEIGHT if nodes[i].tag == TEXT else 1.0
            for what in seen:
                x, y = self.shown.get(what, none)
                here0[i] += weight * x
                here1[i] += weight * y
        up0, up1 = [0.0] * n, [0.0] * n
        moves = [self._moves(nodes[x.parent].tag, x.tag) for x in nodes]
        for i in range(n - 1, 0, -1):
            (a0, a1), (b0, b1) = moves[i]
            p = nodes[i].parent
            up0[i] = _add(a0 + here0[i], a1 + here1[i])
            up1[i] = _add(b0 + here0[i], b1 + here1[i])
            here0[p] += up0[i]
            here1[p] += up1[i]
        # the page itself holds content
        down = [0.0] * n
        for i in range(1, n):
            p = nodes[i].parent
            (a0, a1), (b0, b1) = moves[i]
            # the parent's belief without this node's message, as log odds of (content, other)
            odds = (here1[p] - up1[i]) - (here0[p] - up0[i]) + down[p] if p else 60.0
            top = _add(a1, odds + b1)
            low = _add(a0, odds + b0)
            down[i] = top - low
        return [1.0 / (1.0 + exp(max(-700.0, min(700.0, here0[i] - here1[i] - down[i])))) for i in range(n)]


def _add(a: float, b: float) -> float:
    """log(exp a + exp b)."""
    if a < b:
        a, b = b, a
    return a if a - b > 40 else a + log(1.0 + exp(b - a))


def train(pages: Iterable[str]) -> Model:
    """Count the tables on pages whose text blocks begin with their label."""
    moves: Counter = Counter()
    shows: Counter = Counter()
    states: Counter = Counter()
    for html in pages:
        nodes = Page(html).nodes
        content = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            n = nodes[i]
            if n.tag == TEXT:
                content[i] = n.chars if labelled.CONTENT in n.text else 0
                n.text = " ".join(n.text.replace(labelled.CONTENT, "").replace(labelled.OTHER, "").split())
            if i:
                content[n.parent] += content[i]
        state = [1] + [int(content[i] > 0) for i in range(1, len(nodes))]
        for i, seen in enumerate(observe(nodes)):
            if i:
                p = nodes[i].parent
                moves[nodes[p].tag, nodes[i].tag, state[p], state[i]] += 1
                moves["", nodes[i].tag, state[p], state[i]] += 1
                states[nodes[i].tag == TEXT, state[i]] += 1
                for what in seen:
                    shows[what, state[i]] += 1
    both = Counter()
    for (parent, _, s, c), k in moves.items():
        both[s, c] += k if not parent else 0
    anywhere = tuple(tuple(log((both[s, c] + 1) / (both[s, 0] + both[s, 1] + 2)) for c in (0, 1)) for s in (0, 1))
    move: dict[tuple[str, str, int], tuple[float, float]] = {}
    for parent, tag, s in sorted({k[:3] for k in moves}):  # by tag alone first
        coarse, worth = (move["", tag, s], PRIOR) if parent else (anywhere[s], 0.05)
        n = moves[parent, tag, s, 0] + moves[parent, tag, s, 1]
        move[parent, tag, s] = tuple(log((moves[parent, tag, s, c] + worth * exp(coarse[c])) / (n + worth)) for c in (0, 1))
    texts = ("size ", "links ", "sentence ", "copyright")
    shown = {what: tuple(log((shows[what, c] + 0.5) / (states[what.startswith(texts), c] + 1)) for c in (0, 1)) for what in {w for w, _ in shows}}
    return Model(move, anywhere, shown)


@cache
def trained(n: int = labelled.PAGES, seed: int = 42) -> Model:
    return train(labelled.pages(n, seed))


def main_text(html: str, model: Model) -> str:
    """The blocks of the main text in page order, one to a line."""
    nodes = Page(html).nodes
    return "\n".join(n.text for n, p in zip(nodes, model.marginals(nodes), strict=True) if n.tag == TEXT and p > 0.5 and n.text)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", n_labelled: int = labelled.PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page, or one without main text, has the empty text. Character references are decoded,
    white space in a block is one space, blocks are joined by line feeds. Rows that repeat are extracted alike;
    an empty table gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained(n_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), shared.value) for h in b.column("_h")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), whole(F.col(html)).alias("_h"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
