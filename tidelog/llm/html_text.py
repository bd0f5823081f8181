"""Main text of HTML pages by composite text density.

A page is parsed into blocks. Every block has a composite density: its characters for each tag, damped
by the share of them that stands in links. A block's sum is that of its children's densities. Of the
blocks on which the path from the body is at least as dense as the body itself, the one with the
largest sum is the core of the article, and the least density on its path the threshold. The article is
the highest block on the path that holds another block of the threshold's density, a heading of the page
or is marked up as an article; lists of links that stay under the threshold beside the core are left
out.

Densities are of the page as it is, with its menus, adverts and comments; only what no reader sees as
text, such as scripts and form controls, has none. Elements and the words of class, id and role then say
what is no part of an article: such a block is never the core, and is left out of the article it lies in,
unless it holds the page itself, as a frame called "with-sidebar" or a form around the whole body does.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import map_rows, table

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements without text of their own, and those that are no part of an article.
SKIPPED = frozenset("script style title textarea xmp noframes head select option input noscript template iframe object svg canvas audio video map".split())
APART = frozenset("nav footer button fieldset label dialog menu".split())
# Elements that are left out unless they hold the page.
JUDGED = frozenset("header aside form".split())
CLOSED_BY_BLOCK = frozenset("p".split())
# Elements that end an open one of the same kind.
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table article section div main body blockquote".split())
# Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar side aside complementary contentinfo search "
    "comment comments respond reply replies disqus discussion share sharing social related recommended newsletter subscribe signup login form pagination pager toolbar widget".split()
)

# A value may stand without quotes, and quotes within it or within a name are characters like any other.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)"""
_PAIR = rf"[^\s/>=]++(?:\s*+=\s*+{_VALUE}?+)?+"
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/=]++|{_PAIR})*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(rf"([^\s/>=]++)(?:\s*+=\s*+({_VALUE})?+)?+")
_WORDS = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Node:
    tag: str
    parent: "Node | None" = None
    skipped: bool = False
    suspect: bool = False  # marked by its attributes, or an element of JUDGED
    apart: bool = False  # no part of an article
    parts: list = field(default_factory=list)  # child blocks, and runs of text as [text, is linked]
    links: int = 0
    chars: int = 0
    linked: int = 0
    tags: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


def _marked(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id", "role") and any(w in MARKS for w in _WORDS.findall(value)):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of blocks; inline elements are part of the block they stand in."""
    root = Node("body")
    at, node, open_tags, anchor = 0, root, [], 0

    def text(upto: int) -> None:
        if upto > at and not node.skipped:
            node.parts.append([page[at:upto], anchor > 0])

    def close(down_to: int) -> None:
        nonlocal node, anchor
        while len(open_tags) > down_to:
            tag, block = open_tags.pop()
            if block is not None:
                node = block.parent
            elif tag == "a":
                anchor -= 1

    for found in _MARKUP.finditer(page):
        if found.start() < at:
            continue  # inside a raw element
        text(found.start())
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    close(i)
                    break
                if open_tags[i][0] in LIMITS and name in INLINE:
                    break
            continue
        if name in ("html", "body"):
            if name == "body":
                close(0)
            continue
        if name in VOID:
            if name == "br" and not node.skipped:
                node.parts.append([" ", False])
            elif name not in INLINE and not node.skipped:
                node.parts.append(Node(name, node))  # a border between blocks
            continue
        if name not in INLINE:
            _imply(name, open_tags, close)
        suspect = _marked(found[3] or "")
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in INLINE and not suspect:
            open_tags.append((name, None))
            if name == "a":
                anchor += 1
                node.links += not node.skipped
            continue
        child = Node(name, node, skipped=node.skipped or name in SKIPPED, suspect=suspect or name in JUDGED, apart=name in APART)
        node.parts.append(child)
        open_tags.append((name, child))
        node = child
    text(len(page))
    _judge(root)
    return root


def _judge(root: Node) -> None:
    """Set suspects apart, but not those that hold the page: the only article, a main element, or a heading and two paragraphs."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node))
    seen = {id(n): [n.tag == "main", n.tag == "h1", n.tag == "p"] for n in order}
    articles = sum(n.tag == "article" for n in order)
    for node in reversed(order):
        mains, heads, paragraphs = seen[id(node)]
        only = node.tag == "article" and articles == 1
        if node.suspect and not only and not mains and not (heads and paragraphs >= 2):
            node.apart = True
        if node.parent is not None and not node.skipped and not node.apart:
            above = seen[id(node.parent)]
            for i, n in enumerate(seen[id(node)]):
                above[i] += n


def _imply(name: str, open_tags: list, close) -> None:
    """End the elements that the start of block ``name`` ends."""
    for i in range(len(open_tags) - 1, -1, -1):
        tag = open_tags[i][0]
        if tag in CLOSED_BY_BLOCK or tag in LIKE.get(name, ()):
            close(i)
            return
        if tag in LIMITS:
            return


def _clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def _measure(root: Node) -> list[Node]:
    """Fill in the counts of every block kept, children first; returns them in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.skipped:
            order.append(node)
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    for node in reversed(order):
        node.tags, node.link_tags = node.links, node.links
        for part in node.parts:
            if isinstance(part, Node):
                if not part.skipped:
                    node.chars += part.chars
                    node.linked += part.linked
                    node.tags += part.tags + 1
                    node.link_tags += part.link_tags
            else:
                n = len(_clean(part[0]))
                node.chars += n
                node.linked += n * part[1]
    for node in order:
        node.density = density(node, root)
    for node in order:
        node.total = sum(p.density if isinstance(p, Node) else 0.0 for p in node.parts)
        node.total += sum(len(_clean(p[0])) for p in node.parts if not isinstance(p, Node) and not p[1])
    return order


def density(node: Node, body: Node) -> float:
    """Characters a tag, times the logarithm of how they and the tags divide between links and the rest."""
    if not node.chars:
        return 0.0
    plain = max(1, node.chars - node.linked)
    base = math.log(node.chars / plain * node.linked + body.linked / max(1, body.chars) * node.chars + math.e)
    inside = node.chars / max(1, node.linked) * max(1, node.tags) / max(1, node.link_tags)
    return node.chars / max(1, node.tags) * math.log(max(inside, 1.0)) / math.log(max(base, 1.0 + 1e-9))


def core(root: Node, order: list[Node] | None = None) -> Node:
    """Of the blocks that are dense all the way from the body, the one with the largest sum of densities."""
    order = _measure(root) if order is None else order
    dense, best = {id(root)}, root
    for node in order:
        if node is root or node.apart:
            continue
        if id(node.parent) in dense and node.density >= root.density:
            dense.add(id(node))
            if node.total > best.total or (best is root and node.total >= root.total):
                best = node
    return best


def article(root: Node) -> Node:
    """The block that holds all of the article: the core, the dense blocks beside it and what lies between."""
    order = _measure(root)
    found = _whole(core(root, order), root, order)
    for node in order:
        node.skipped |= node.apart
    return found


def _whole(core: Node, root: Node, order: list[Node]) -> Node:
    """The highest block on the path of ``core`` that has more of the article; its lists of links beside ``core`` are skipped."""
    path = [core]
    while path[-1] is not root:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    peak = {id(n): n.density for n in order}  # the densest block within each
    for node in reversed(order):
        if node is not root and not node.apart:
            peak[id(node.parent)] = max(peak[id(node.parent)], peak[id(node)])
    top = 0
    for i, node in enumerate(path[1:], 1):
        others = [p for p in node.parts if isinstance(p, Node) and not p.skipped and not p.apart and p.chars and p is not path[i - 1]]
        runs = [(len(_clean(p[0])), p[1]) for p in node.parts if not isinstance(p, Node)]
        loose = Node("", chars=sum(n for n, _ in runs), linked=sum(n * linked for n, linked in runs), tags=node.links, link_tags=node.links)
        dense = any(peak[id(p)] >= threshold for p in others) or (loose.chars and density(loose, root) >= threshold)
        titled = node is not root and any(p.tag == "h1" for p in others)
        if dense or titled or node.tag == "article":
            top = i
    beside = set(map(id, path[:top]))
    stack = [path[top]]
    while stack:
        for p in stack.pop().parts:
            if isinstance(p, Node) and not p.skipped and not p.apart and p is not core:
                if id(p) not in beside and peak[id(p)] < threshold and p.link_tags > 2 and 2 * p.linked > p.chars:
                    p.skipped = True
                else:
                    stack.append(p)
    return path[top]


def blocks(node: Node) -> list[str]:
    """The texts of the blocks under ``node`` in page order, without empty ones."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if joined := _clean("".join(run)):
            out.append(joined)
        run.clear()

    stack: list = [iter(node.parts)]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            flush()
        elif isinstance(part, Node):
            if part.skipped and part.tag in INLINE:
                continue
            flush()
            if not part.skipped:
                stack.append(iter(part.parts))
        else:
            run.append(part[0])
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(article(parse(page)))) if page else ""


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html, ...)``.

    Null and empty pages, and pages without a text, give an empty text. Repeated rows come out as often
    as they went in; an empty table gives no rows. Other columns are ignored.
    """

    def kernel(columns: list) -> list:
        texts = [main_text(page) for page in columns[2]]
        return [columns[0], columns[1], texts, [len(t) for t in texts]]

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), kernel, ["page_id", "url", "html"], SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
