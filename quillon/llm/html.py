"""HTML extraction by composite text density.

A page becomes a tree of nodes. Each node's density is its characters for each tag below it,
adjusted by the characters and tags of links (Sun, Song and Liao's composite text density);
tags inside a line of text, but for links, count as text. The subtree with the greatest sum of
its children's densities holds the main text. The threshold is the least density on the path
from the body to it; the subtree grows to its parent as long as neighbours reach the threshold,
and to the article element that it lies in. Parts that the markup itself names as no article
text (menus, headers, footers, asides, forms, scripts, adverts, notices, comments) don't enter
the counts, nor do lists of links inside the article its text. Names that an article's own
sections may have as well (discussion, responses) count only where a form or a comment's parts
stand below. All of it takes time in proportion to the page.

Defined results: null and empty pages have no text; a page without tags is one block; text
outside of any element counts as the body's; an element left open ends where its parent ends; a
tag that the page's end cuts off has no text; elements nested deeper than DEEPEST are siblings;
repeated rows are extracted alike; an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without content, with raw content, and those that end others.
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"br", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "html", "legend"}
#: An element's start ends an open one of these, up to the boundary elements.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements that are no article text whatever their density.
APART = frozenset("nav footer aside form script style noscript template head title button select option textarea input label iframe object embed svg canvas dialog menu search audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words in class and id that name such parts. The first never hold an article; the others
#: may be the name of what is around it, so they count only while most text is elsewhere.
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsors sponsored promo promos promoted promotion promotions outbrain taboola "
    "cookie cookies consent gdpr comment comments commentlist commenting disqus respond reply replies guestbook "
    "newsletter popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars aside footer masthead topbar toolbar share sharing sharebar hidden visuallyhidden".split()
)
APART_NAMES = NEVER_NAMES | frozenset(
    "banner banners notice notices notification notifications alert alerts announcement announcements disclaimer subscribe subscription signup signin login register "
    "side rail widget widgets foot copyright social follow related recommended recommendations recommendation trending popular teaser teasers "
    "search form forms skip thread feedback reviews header".split()
)
#: Words that name reader comments or a section of the article, and what tells the former.
TALK_NAMES = frozenset("discussion discussions response responses".split())
TALK_SIGNS = frozenset("comment comments commenter reply replies avatar user username vcard respond".split())
#: Words that make a named header the article's own.
OWN_NAMES = frozenset("article entry post story content".split())

#: A quote counts only where a value begins, and lasts to the next one or to the page's end.
VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+)"
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE}?+)?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>][^\s>]*+))?+)?+")
#: Levels of elements, as browsers have them.
DEEPEST = 512
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """skip: no part of any article. named: only its class or id says so, 2 if by a name that
    may also be around an article, 3 if by one of a section of the article or of comments."""

    __slots__ = ("chars", "children", "density", "depth", "link_chars", "link_tags", "name", "named", "parent", "skip", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, skip: bool = False, named: int = 0):
        self.name, self.parent, self.skip, self.named = name, parent, skip, named
        self.depth = 0 if parent is None else parent.depth + 1
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def apart(name: str, attributes: str, parent: Node) -> tuple[bool, int]:
    """(no article text, as Node.named)."""
    if name in APART or name == "header" and parent.name not in ("article", "main", "section"):
        return True, 0
    named = 0
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "")
        key, low = key.lower(), value.lower()
        if key == "hidden" or key == "aria-hidden" and low == "true" or key == "role" and low in ROLES:
            return True, 0
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return True, 0
        if key in ("class", "id") and name not in ("html", "body", "main", "h1"):
            words = {w.lower() for w in NAME_PART.findall(value)} | set(low.split())
            if "header" in words and words & OWN_NAMES:
                words.discard("header")
            if words & NEVER_NAMES:
                return True, 1
            named = named or 2 * bool(words & APART_NAMES) or 3 * bool(words & TALK_NAMES)
    return named in (1, 2), named


def is_sign(name: str, attributes: str) -> bool:
    """A form, or a part of a reader's comment."""
    if name in ("form", "textarea", "input"):
        return True
    return any(key.lower() in ("class", "id") and not TALK_SIGNS.isdisjoint(w.lower() for w in NAME_PART.findall("".join(values))) for key, *values in ATTRIBUTE.findall(attributes))


def parse(page: str) -> Node:
    """The tree below a root; elements without content aren't in it, but for br and hr."""
    root = Node("#root", None)
    at, open_, end = 0, root, len(page)
    candidates: list[Node] = []  # left out by a name that may be around the article
    talks: dict[int, Node] = {}  # sections by a name of TALK_NAMES that no sign of comments is in

    def close(to: Node) -> Node:
        return to.parent or root

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        if mark > at:
            open_.children.append(page[at:mark])
        if mark == end:
            break
        m = TAG.match(page, mark)
        if not m:
            open_.children.append("<")
            at = mark + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            node = open_
            while node is not root and node.name != name:
                node = node.parent
            if node is not root:
                open_ = close(node)
            elif name == "p":
                open_.children.append(Node("p", open_))
            elif name == "br":
                open_.children.append(Node("br", open_))
            continue
        if name in ENDS_P:
            node = open_
            while node is not root and node.name not in ("p", "td", "th", "button", "caption", "object", "html", "body", "article", "section", "div"):
                node = node.parent
            if node.name == "p":
                open_ = close(node)
        if name in SIBLINGS:
            ends, bounds = SIBLINGS[name]
            node = open_
            last = None
            while node is not root and node.name not in bounds:
                if node.name in ends:
                    last = node
                node = node.parent
            if last is not None:
                open_ = close(last)
        if name == "body":  # what came before belongs to the head
            while open_.name in ("head", "p"):
                open_ = close(open_)
        while open_.depth >= DEEPEST:
            open_ = close(open_)
        attributes = m[3] or ""
        if talks and is_sign(name, attributes):
            up: Node | None = open_
            while up is not None:
                if talks.pop(id(up), None) is not None:
                    up.skip = True
                up = up.parent
        node = Node(name, open_, *apart(name, attributes, open_))
        open_.children.append(node)
        if node.named == 2:
            candidates.append(node)
        if node.named == 3:
            talks[id(node)] = node
        if name in ("article", "main") and not node.skip:
            # A wrapper around the article isn't left out for its name ("with-sidebar").
            above = open_
            while above is not None:
                above.skip = above.skip and not above.named
                above = above.parent
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if stop is None:
                at = end
            else:
                if not node.skip:
                    node.children.append(page[at : stop.start()])
                at = page.find(">", stop.start()) + 1 or end
            continue
        open_ = node
    if any(node.skip for node in candidates):
        sizes = texts_of(root)
        for node in candidates:
            chars, links = sizes.get(id(node), (0, 0))
            if node.skip and 2 * chars > sizes[id(root)][0] - links:
                node.skip = False
    return root


def texts_of(root: Node) -> dict[int, tuple[int, int]]:
    """For each node that may be an article's, by its id: characters below it, and those of links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and (not c.skip or c.named == 2)]
    out: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        chars = links = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c.strip())
            elif id(c) in out:
                chars, links = chars + out[id(c)][0], links + out[id(c)][1]
        out[id(node)] = chars, chars if node.name == "a" else links
    return out


def decoded(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def in_order(root: Node) -> list[Node]:
    """The node and those below it, without what is left out."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.skip]
    return out


def is_block(node: Node) -> bool:
    return node.name in BLOCK or node.name in ("body", "html", "#root")


def weigh(nodes: list[Node], body: Node) -> None:
    """Characters, tags, densities and their sums; nodes come in order, parents first."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(decoded(c).split()))
            elif not c.skip:
                link = c.name == "a"
                node.chars += c.chars
                node.tags += c.tags + (link or is_block(c))
                node.link_chars += c.chars if link else c.link_chars
                node.link_tags += c.link_tags + link
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        node.density = density(node, ratio)
        inner = [c for c in node.children if isinstance(c, Node) and not c.skip and is_block(c) and c.name not in ("br", "hr")]
        node.sum = sum(c.density for c in inner) if inner else node.density


def density(node: Node, ratio: float) -> float:
    """Composite text density: characters a tag, less the more of both are links."""
    if not node.chars:
        return 0.0
    tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(node.chars / plain * node.link_chars + ratio * node.chars + math.e)
    weight = math.log(max(node.chars * tags / (links * link_tags), 1.0)) / math.log(max(base, 1.05))
    return node.chars / tags * weight


def article(root: Node) -> Node:
    """The subtree that is the article."""
    nodes = in_order(root)
    body = next((n for n in nodes if n.name == "body"), root)
    weigh(nodes, body)
    best = max((n for n in in_order(body) if is_block(n)), key=lambda n: n.sum, default=body)
    threshold, path, node = best.density, [], best
    while node is not None:
        path.append(node)
        threshold = min(threshold, node.density)
        node = node.parent if node is not body else None
    for name in ("article", "main"):
        if own := [n for n in path if n.name == name]:
            return own[-1]
    inner = [n for n in in_order(best) if n.name in ("article", "main") and n.chars > 0.5 * best.chars]
    if inner:
        return inner[0]
    while best is not body and best.parent is not None and any(dense(c, threshold, best) for c in best.parent.children if c is not best):
        best = best.parent
    return best


def dense(child: Node | str, threshold: float, best: Node) -> bool:
    """A neighbour that is text as dense as the path from the body, no links, and no mere line."""
    return isinstance(child, Node) and (child.chars >= 100 or 10 * child.chars >= best.chars) and not child.skip and is_block(child) and child.chars > 0 and child.density >= threshold and child.link_chars <= 0.5 * child.chars


def mostly_links(node: Node) -> bool:
    return node.name in ("ul", "ol", "div", "section", "table") and node.link_tags > 1 and node.link_chars > 0.8 * node.chars and not has_running_text(node)


def has_running_text(node: Node) -> bool:
    """A paragraph directly below: links in it are an article's own words."""
    return any(isinstance(c, Node) and c.name in ("p", "blockquote") and c.chars for c in node.children)


def above(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def extract(page: str | None) -> str:
    """The article's blocks in page order, one a line."""
    if not page:
        return ""
    root = parse(page)
    top = article(root)
    lines: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            lines.append(text)
        line.clear()

    todo: list[Node | str | None] = [top]
    headings = [n for n in in_order(root) if n.name == "h1"]
    if len(headings) == 1 and top not in above(headings[0]) and headings[0].parent in above(top):
        # The only main heading, next to the article or to what is around it, belongs to it.
        todo.append(headings[0])
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(decoded(x))
        elif not x.skip and not (x is not top and mostly_links(x)):
            if is_block(x):
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return "\n".join(lines)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = [extract(p.as_py()) for p in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
