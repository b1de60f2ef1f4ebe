"""Main text of web pages: paragraphs score their containers, the best container is kept."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import free_name

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Never part of an article.
DROPPED = set(
    "script style noscript template head title button select textarea iframe svg canvas object audio video".split()
)
#: Around an article, unless the article stands inside.
SURROUNDS = set("nav header footer aside menu".split())
WRAPPERS = set("form dialog".split())
PARAGRAPHS = set("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption td th caption summary".split())
#: Start tags that close an open tag of the same set.
CLOSES = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"},
          "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
#: Words of a class, id or role that mark what surrounds an article.
AROUND = set(
    "ad ads advert adverts advertisement advertising cookie cookies consent newsletter subscribe comment comments "
    "reply replies disqus sidebar breadcrumb breadcrumbs menu nav navbar navigation footer masthead toolbar "
    "pagination pager popup modal".split()
)
#: Words that may also name a subject or a page's frame: what they mark goes only if it is the smaller part.
MAYBE = set(
    "sponsor sponsored promo promotion banner notice notices related recommended share sharing social header widget "
    "login search complementary contentinfo alert".split()
)
ARTICLE = set("article main content post body entry story text with has no without".split())
_FREE, _MAYBE, _SURE = 0, 1, 2


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    found = dict(attributes)
    return "hidden" in found or bool(re.search(r"display\s*:\s*none", found.get("style") or ""))


def _around(tag: str, attributes: list[tuple[str, str | None]]) -> int:
    """How surely an element surrounds the article, by its tag and the words of its class, id and role."""
    level = _SURE if tag in SURROUNDS else _MAYBE if tag in WRAPPERS else _FREE
    if tag in ("html", "body", "main", "article"):
        return _FREE
    found = dict(attributes)
    for value in (found.get("class"), found.get("id"), found.get("role")):
        for name in (value or "").split():
            parts = {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
            if not parts & ARTICLE:
                level = max(level, _SURE if parts & AROUND else _MAYBE if parts & MAYBE else _FREE)
    return level


class _Node:
    __slots__ = ("tag", "kind", "parent", "depth", "points", "size", "linked", "main", "around", "holds_main", "flag")

    def __init__(self, tag: str, parent: _Node | None, main: bool = False, kind: str = "", around: int = _FREE):
        self.tag, self.parent, self.main, self.kind, self.around = tag, parent, main, kind, around
        self.depth = parent.depth + 1 if parent else 0
        self.points = 0.0
        self.size = self.linked = 0
        self.holds_main = self.flag = False

    def plain(self) -> int:
        return self.size - self.linked

    def score(self) -> float:
        return self.points * (1 - self.linked / self.size) if self.size else 0.0


class _Page(HTMLParser):
    """Cuts a page into blocks of text, each with the node it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", None)
        self.open = [self.root]
        self.nodes = [self.root]  # in page order, so parents come before their children
        self.open_tags: Counter[str] = Counter()
        self.dropped = 0  # open elements from the outermost dropped one on
        self.links = 0
        self.blocks: list[tuple[_Node, str, int]] = []
        self.pieces: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            node = next((n for n in reversed(self.open) if n.tag not in INLINE), self.root)
            self.blocks.append((node, text, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def _block(self) -> int:
        """Place of the innermost open element that is no inline one."""
        at = len(self.open) - 1
        while at and self.open[at].tag in INLINE:
            at -= 1
        return at

    def _pop_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.links -= node.tag == "a"
            self.open_tags[node.tag] -= 1
        self.dropped = max(0, self.dropped - (len(self.open) - at)) if self.dropped else 0
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if not self.dropped:
                if tag == "br":
                    self.pieces.append(" ")
                elif tag == "hr":
                    self.flush()
            return
        if tag not in INLINE:
            if not self.dropped:
                self.flush()
            closed = CLOSES.get(tag, {"p"})
            while (at := self._block()) and self.open[at].tag in closed:
                self._pop_to(at)
        main = tag in ("article", "main") or ("role", "main") in attrs
        node = _Node(tag, self.open[-1], main, dict(attrs).get("class") or "", _around(tag, attrs))
        self.open.append(node)
        self.nodes.append(node)
        self.open_tags[tag] += 1
        self.links += tag == "a"
        if self.dropped:
            self.dropped += 1
        elif tag in DROPPED or _hidden(attrs):
            self.dropped = 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag(tag, [])
            return
        if not self.open_tags[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                if tag not in INLINE and not self.dropped:
                    self.flush()
                self._pop_to(at)
                return
            if tag in INLINE and self.open[at].tag not in INLINE:
                return

    def handle_data(self, data):
        if self.dropped:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data.strip())


def _spread(nodes: list[_Node], chosen) -> None:
    """Flag the chosen nodes and all below them."""
    for node in nodes:
        node.flag = chosen(node) or node.parent is not None and node.parent.flag


def _drop_surroundings(page: _Page) -> list[tuple[_Node, str, int]]:
    """The blocks outside of what surrounds the article.

    An element stays that holds an ``article`` or ``main``, and one that only may surround it if
    it holds most of the page's text, or more than stands outside of all such elements.
    """
    nodes = page.nodes
    for node, text, linked in page.blocks:
        node.size += len(text)
        node.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.holds_main |= node.main and node.size > 0 or node.holds_main
    for node in nodes:
        if node.around and (node.holds_main or node.around == _MAYBE and 2 * node.plain() > page.root.plain()):
            node.around = _FREE
    _spread(nodes, lambda n: n.around)
    outside = sum(len(text) - linked for node, text, linked in page.blocks if not node.flag)
    largest = max((n for n in nodes if n.around == _MAYBE), key=_Node.plain, default=None)
    if largest is not None and largest.plain() > outside:
        while largest is not None:
            if largest.around == _MAYBE:
                largest.around = _FREE
            largest = largest.parent
        _spread(nodes, lambda n: n.around)
    return [block for block in page.blocks if not block[0].flag]


def main_text(html: str | None) -> str:
    """The article of one page: a block per line, white space inside a block as one space."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    blocks = _drop_surroundings(page)
    if not blocks:
        return ""
    for node in page.nodes:
        node.size = node.linked = 0
    for node, text, linked in blocks:
        node.size += len(text)
        node.linked += linked
        holder = node.parent if node.tag in PARAGRAPHS and node.parent else node
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        holder.points += points
        if holder.parent:
            holder.parent.points += points / 2
    for node in reversed(page.nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
    holders = [n for n in page.nodes if n.size]
    best = max(holders, key=lambda n: (n.score(), n.depth))
    above = best
    while above is not None and not above.main:
        above = above.parent
    best = above or best
    least = best.score() / 5
    kept = {id(best)}
    for node in holders:
        if node.parent is best.parent and node.parent is not None:
            few_links = node.linked <= node.size / 4
            alike = not best.main and few_links and (node.tag in PARAGRAPHS or (node.tag, node.kind) == (best.tag, best.kind))
            if alike or node.score() >= least and node.main == best.main:
                kept.add(id(node))
    _spread(page.nodes, lambda n: id(n) in kept)
    return "\n".join(text for node, text, _ in blocks if node.flag)


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of the column ``html`` as a further column ``into``.

    Paragraphs pass points for their length and commas to their container and half of them to the
    one above; points shrink by the share of linked characters. The best container is kept with
    those of its siblings that score a fifth of it or are paragraphs with few links; inside an
    ``article`` or ``main`` element the whole of it is kept. Menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles and reader comments are left out before scoring.

    A null, empty or textless page gives an empty text. Rows and other columns stay as they are; a
    column ``into`` of the input is replaced. Pages are read one at a time in each task.
    """
    @F.pandas_udf("string")
    def texts(columns: pd.Series) -> pd.Series:
        return columns.map(main_text)

    name = free_name(pages, "extracted")
    out = pages.withColumn(name, texts(F.col(f"`{html}`").cast("string")))
    return out.drop(into).withColumnRenamed(name, into) if into != name else out
