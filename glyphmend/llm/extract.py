"""Main text of html pages by composite text density.

The page becomes a tree of nodes (unclosed paragraphs and cells close as browsers close them).  Scripts, styles,
controls and the like are no text.  Each node has

    density = characters / tags, link-adjusted:
    (C / T) * log_{ln(C / notL * L + Lc / C * C + e)} (C / L * T / Lt)

with characters C and tags T, of which Lc and Lt in links, and notL = C - Lc.  Furniture of the page (menus,
headers, footers, sidebars, forms; adverts, notices, reader comments by a word of class, id or role) counts with
``FURNITURE`` of its density, wherever it stands; nothing is dropped for its name alone.  The node with the
largest sum of its children's densities is the main subtree; the least density on its path to the body is the
threshold.  On the path up to the article around it (else to the body), siblings at or above the threshold and
headings belong to it.  Inside the subtrees chosen, furniture goes unless it holds nearly all of their text, and
the header of an article stays, as it holds the title; all other blocks are kept, in page order.

Defined cases: null and empty html and pages without text give an empty text; broken markup is closed at
the end of the input; very long pages are parsed whole, without recursion; repeated rows are treated
alike; of nodes with equal sums the first in the page is chosen; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template iframe object svg canvas head title button select option textarea datalist".split())
#: Elements that are furniture by their tag.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog label".split())
#: Share of its density with which furniture counts; in a subtree it stays if that much of its text is more than all the rest.
FURNITURE = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that stay inside their block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of the same family, up to a bound.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that lower a node as furniture of the page.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices popup modal overlay"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside header footer masthead complementary contentinfo"
    " comment comments commentlist respond disqus replies share sharing social related recommended newsletter subscribe login signup search form pagination pager toolbar widget skip".split()
)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "furniture", "within", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, furniture: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.furniture, self.children = tag, parent, dropped, furniture, []
        #: Itself or something around it is furniture.
        self.within = furniture or (parent is not None and parent.within)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_furniture(tag: str, attrs: list[tuple[str, str | None]], parent: Node) -> bool:
    if tag in FURNITURE_TAGS and not (tag == "header" and _inside(parent, "article")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if value and name in ("class", "id", "role") and not MARKS.isdisjoint(_WORD.findall(value.lower())):
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _inside(node: Node | None, tag: str) -> bool:
    while node is not None and node.tag != tag:
        node = node.parent
    return node is not None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#root", None)

    def _close_to(self, node: Node) -> None:
        self.open = node.parent

    def _find_open(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> Node | None:
        at = self.open
        while at.parent is not None and at.tag not in bounds:
            if at.tag in tags:
                return at
            at = at.parent
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and (p := self._find_open({"p"}, {"button", "td", "th", "article", "section", "div", "blockquote", "li"})):
            self._close_to(p)
        elif tag in SIBLINGS:
            family, bounds = SIBLINGS[tag]
            while sibling := self._find_open(family, bounds):
                self._close_to(sibling)
        if tag == "body" and (at := self._find_open({"head"}, set())):
            self._close_to(at)
        node = Node(tag, self.open, self.open.dropped or tag in DROPPED, _is_furniture(tag, attrs, self.open))
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = self.open
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open is not before and self.open.tag in ("svg", "path"):
            self.open = self.open.parent

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at.parent is not None:
            if at.tag == tag:
                self.open = at.parent
                return
            if at.tag in ("td", "th", "table", "body") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                return
            at = at.parent

    def handle_data(self, data: str) -> None:
        if not self.open.dropped:
            self.open.children.append(data)


def _preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return out


def _measure(nodes: list[Node]) -> None:
    """Counts, densities and sums of all nodes, children before parents."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if not c:
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        node.density = c / t * max(0.0, math.log(c / max(1, lc) * t / lt + 1e-9) / math.log(base) if base > 1.0 + 1e-9 else math.log(c / max(1, lc) * t / lt + 1e-9))
    for node in nodes:
        node.total = sum(_counted(c) for c in node.children if isinstance(c, Node) and not c.dropped)
        if any(isinstance(c, str) and not c.isspace() for c in node.children):
            node.total = max(node.total, node.density)


def _counted(node: Node) -> float:
    return node.density * (FURNITURE if node.furniture else 1.0)


def _main(nodes: list[Node]) -> list[Node]:
    """The subtree of the largest sum of densities, with what its body path's threshold adds, in page order."""
    blocks = [n for n in nodes if n.tag not in INLINE and n.chars]
    if not blocks:
        return []
    # A paragraph cut up by inline elements can outweigh its container: nodes that hold blocks come first.
    holders = [n for n in blocks if any(isinstance(c, Node) and c.chars and c.tag not in INLINE for c in n.children)]
    best = max(holders or blocks, key=lambda n: n.total * (FURNITURE if n.within else 1.0))
    threshold, at = best.density, best
    while at.parent is not None and at is not nodes[0]:
        at = at.parent
        threshold = min(threshold, at.density)
    chosen, at = {id(best)}, best
    # An article stands for itself: what lies beside one is not part of it.
    while at.tag != "article" and at is not nodes[0] and at.parent is not None and at.parent is not nodes[0]:
        at = at.parent
        chosen |= {id(c) for c in at.children if isinstance(c, Node) and not c.dropped and c.chars and not c.furniture and c.tag != "article" and (_counted(c) >= threshold or _is_heading(c))}
    out, todo = [], [nodes[0]]
    while todo:
        node = todo.pop()
        if id(node) in chosen and not (node is not best and _holds(node, best)):
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return out


def _is_heading(node: Node) -> bool:
    return node.tag in HEADINGS or (node.tag == "header" and any(isinstance(c, Node) and c.tag in HEADINGS for c in node.children))


def _holds(node: Node, other: Node) -> bool:
    at = other.parent
    while at is not None and at is not node:
        at = at.parent
    return at is not None


def _blocks(root: Node) -> Iterator[str]:
    parts: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is None:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                yield text
        elif x.dropped or (x is not root and x.furniture and FURNITURE * x.chars <= root.chars - x.chars):
            continue
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag in INLINE and x is not root:
            todo += reversed(x.children)
        else:
            todo += [None, *reversed(x.children), None]


def main_text(html: str | None) -> str:
    """The main text of a page, blocks joined by blank lines."""
    if not html:
        return ""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    nodes = _preorder(builder.root)
    body = next((n for n in nodes if n.tag == "body"), builder.root)
    nodes = _preorder(body)
    _measure(nodes)
    return "\n\n".join(block for part in _main(nodes) for block in _blocks(part))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b["_html"].to_pylist()]
        kept = [c for c in b.schema.names if c != "_html"]
        yield pa.RecordBatch.from_arrays([b[c] for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for each row of pages."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInArrow(_extract, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
