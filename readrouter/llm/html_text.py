"""HTML extraction by composite text density.

Every block element gets a density: characters per tag, adjusted by the share of characters and tags in links. A node's
density sum adds those of its block children and of its own runs of text. The subtree with the largest sum is the
article's core; the least density on its path to the body is the threshold above which further subtrees are taken too.
An enclosing article or main element of the core is taken whole. Elements that are never part of an article
(navigation, footers, forms, scripts, ...) go first, by tag or role. Elements with only such words in a class or id
go unless they are headings or hold the densest subtree.

Defined results: null or empty html gives an empty text; html without any tag is one block of text; an unclosed element ends with
its parent; an unclosed comment, script or tag runs to the end of the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")

# HTML element names by their role, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
NEVER = frozenset("nav footer aside form script style noscript template button select textarea iframe object embed svg canvas audio video dialog menu head title noembed noframes map input datalist".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Classes and ids that mark an element as apart from the article unless it holds the densest subtree.
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar comment comments disqus discussion replies reply respond related recommended recommendations share sharing social tags toc search skip paywall".split())
WORDS_OF = re.compile(r"[A-Za-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "marked", "depth", "block", "holds_block", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False, marked: bool = False):
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped, marked
        self.depth = parent.depth + 1 if parent is not None else 0
        #: The nearest element that isn't inline, itself included.
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.children: list = []  # nodes, and strings for runs of text


class Open:
    """The open elements, by tag and from the outermost, so that no end tag has to climb past what it closes."""

    def __init__(self, root: Node):
        self.here, self.by_tag = root, {}

    def nearest(self, tag: str) -> Node | None:
        own = self.by_tag.get(tag)
        return own[-1] if own else None

    def enter(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        self.here = node

    def close(self, node: Node) -> None:
        """Close the node and all that is open in it."""
        while True:
            here = self.here
            self.by_tag[here.tag].pop()
            self.here = here.parent
            if here is node:
                return

    def end(self, tag: str) -> bool:
        """Whether there was an element for this end tag; an inline end tag doesn't close blocks."""
        node = self.nearest(tag)
        if node is None or tag in INLINE and node.depth < self.here.block.depth:
            return False
        self.close(node)
        return True

    def before(self, tag: str) -> None:
        """Close what the start of this element ends."""
        if tag in ENDS_P and self.here.block.tag == "p":
            self.close(self.here.block)
        for_it = SAME_CLOSES.get(tag)
        if for_it:
            floor = max((n.depth for n in map(self.nearest, HOLDS[tag]) if n is not None), default=0)
            found = []
            for c in for_it:
                own = self.by_tag.get(c, ())
                at = bisect_right(own, floor, key=lambda n: n.depth)
                found += own[at : at + 1]
            if found:
                self.close(min(found, key=lambda n: n.depth))


def _apart(tag: str, attributes: str, opened: Open) -> bool:
    if tag in NEVER:
        return True
    if tag == "header":  # an article's own header holds its title
        return not (opened.nearest("article") or opened.nearest("main"))
    if not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.strip().lower() in NEVER_ROLES:
            return True
    return False


def _marked(tag: str, attributes: str) -> bool:
    """Whether a whole class or id is of NEVER_WORDS alone, as cookie-banner and not as has-sidebar."""
    if not attributes or tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in "".join(values).split():
                words = WORDS_OF.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))
                if words and all(w.lower() in NEVER_WORDS for w in words):
                    return True
    return False


def parse(page: str) -> Node:
    """The page's tree. Character references are decoded; comments, markup and raw-text elements leave no text."""
    root = Node("#root", None)
    opened, at, size = Open(root), 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        start = found.start() if found else size
        if start > at:
            opened.here.children.append(entities.unescape(page[at:start]))
        if not found:
            break
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["close"]:
            if not opened.end(tag) and tag == "p":
                opened.here.children.append(Node("p", opened.here))
            continue
        opened.before(tag)
        node = Node(tag, opened.here, _apart(tag, found["attributes"], opened), _marked(tag, found["attributes"]))
        opened.here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag in ("textarea", "xmp"):
                node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and (tag in INLINE | ENDS_P or not found["attributes"].rstrip().endswith("/")):
            opened.enter(node)
    return root


def _nodes(root: Node) -> list[Node]:
    """Nodes that stay, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return order


def _measure(order: list[Node], body: Node) -> None:
    for node in reversed(order):
        chars = link_chars = tags = link_tags = 0
        node.holds_block = False
        for c in node.children:
            if isinstance(c, str):
                chars += len(SPACE.sub(" ", c).strip())
            elif not c.dropped:
                node.holds_block = node.holds_block or c.tag not in INLINE or c.holds_block
                chars, link_chars = chars + c.chars, link_chars + c.link_chars
                tags, link_tags = tags + c.tags + 1, link_tags + c.link_tags
        if node.tag == "a":
            link_chars, link_tags = chars, tags + 1
        node.chars, node.link_chars, node.tags, node.link_tags = chars, link_chars, tags, link_tags
    whole = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        node.density = _density(node.chars, node.link_chars, node.tags, node.link_tags, whole)
        node.total = 0.0
        for part in _parts(node):
            if isinstance(part, Node):
                node.total += part.density
            else:
                node.total += _density(*part, whole)


def _density(chars: float, link_chars: float, tags: float, link_tags: float, whole: float) -> float:
    """Characters per tag, by the logarithm of its link ratios to a base that grows with the linked share."""
    if not chars:
        return 0.0
    tags, plain = max(tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + whole * chars + math.e)
    ratio = chars / max(link_chars, 1) * (tags / max(link_tags, 1))
    return chars / tags * max(math.log(max(ratio, 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else math.log(max(ratio, 1.0 + 1e-9)), 0.0)


def _parts(node: Node):
    """Block children; runs of text and inline elements between them as (chars, link chars, tags, link tags)."""
    run = [0, 0, 0, 0]
    for c in node.children:
        if isinstance(c, str):
            run[0] += len(SPACE.sub(" ", c).strip())
        elif c.dropped:
            continue
        elif c.tag in INLINE and not c.holds_block:
            run = [run[0] + c.chars, run[1] + c.link_chars, run[2] + c.tags + 1, run[3] + c.link_tags]
        else:
            if run[0]:
                yield tuple(run)
            run = [0, 0, 0, 0]
            yield c
    if run[0]:
        yield tuple(run)


def _is_block(node: Node) -> bool:
    return node.tag not in INLINE or node.holds_block


def _drop_marked(order: list[Node], body: Node) -> bool:
    """Drop the marked elements that don't hold the densest subtree of the others; whether there were any."""
    node = max((n for n in order if not n.marked and _is_block(n)), key=lambda n: n.total, default=body)
    above = {id(node)}
    while node is not body and node.parent is not None:
        node = node.parent
        above.add(id(node))
    found = [n for n in order if n.marked and id(n) not in above]
    for n in found:
        n.dropped = True
    return bool(found)


def select(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    order = _nodes(root)
    body = next((n for n in order if n.tag == "body"), root)
    if any(isinstance(c, Node) and c.tag not in ("head", "body", "html") and not c.dropped for c in root.children):
        body = root  # content outside the body element
    order = _nodes(body)
    _measure(order, body)
    if any(n.marked for n in order) and _drop_marked(order, body):
        order = _nodes(body)
        _measure(order, body)
    if not body.chars:
        return []
    first = {id(n): i for i, n in enumerate(order)}
    best = max(filter(_is_block, order), key=lambda n: (n.total, -first[id(n)]), default=body)
    core = node = best
    threshold = best.density
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
        if node.tag in ("article", "main"):
            core = node
    taken = [core]
    inside = set(map(id, _nodes(core)))
    above, node = set(), core
    while node is not body and node.parent is not None:
        node = node.parent
        above.add(id(node))
    if core.tag not in ("article", "main"):
        # Other subtrees at or above the threshold hold more of the article.
        todo = [n for n in order if id(n) in above]
        for holder in todo:
            for c in holder.children:
                if isinstance(c, Node) and not c.dropped and id(c) not in inside and id(c) not in above and c.tag not in INLINE and c.density >= threshold and c.chars:
                    taken.append(c)
                elif isinstance(c, Node) and not c.dropped and id(c) not in inside and id(c) not in above and c.tag == "h1" and c.chars:
                    taken.append(c)
    return sorted(taken, key=lambda n: first[id(n)])


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks under node, with white space turned into one space and empty ones left out."""
    found, run = [], []

    def flush():
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            found.append(text)

    todo: list = [node]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.dropped:
            continue
        elif item.tag == "br":
            run.append(" ")
        else:
            if item.tag not in INLINE:
                flush()
                todo.append(None)
            todo += reversed(item.children)
    flush()
    return found


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks in page order, one to a line."""
    if not page:
        return ""
    return "\n".join(block for node in select(parse(page)) for block in _blocks(node))


def _extract(batches, html_at):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(html_at).to_pylist()]
        keep = [i for i in range(batch.num_columns) if i != html_at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*(batch.schema.names[i] for i in keep), "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """The op2 contract: page_id, url, text, n_chars."""
    from functools import partial

    return map_arrow(pages.select("page_id", F.col("url"), "html"), partial(_extract, html_at=2), "page_id bigint, url string, text string, n_chars bigint")
