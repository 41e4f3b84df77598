"""Main text of web pages by tree scoring.

A page is read into a tree of elements. Every paragraph passes points to its container: one, one per comma, and up to three for its length; a
container passes on six tenths of its points to its own, and so on to the root, so that the common container of several good ones wins over each.
A container's points are discounted by its link density. The best container is kept (the ``article`` around it, and outer ones or ``main`` if most of that is
in it), with those of its siblings that are paragraphs, headings or read like prose, however few points they have, and its blocks are joined in page order.

Elements that are never article text (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles, reader comments) are left
out before scoring. A class or id that only has such words marks one; where they stand beside others (``related-work``), the element goes
only if it does not read like prose, and inside an article only if it is mostly links. A ``notice`` inside an article goes by how it reads as well. A header counts
as the page's while points are given; one that stands in the chosen container and has a heading is the article's title after all.

Defined cases: a null, empty or text-free page gives an empty text; a page cut off anywhere is read as if its open elements
ended there; character references without an end mark are decoded as browsers do; repeated rows give repeated results; extra
columns are ignored. Time is in proportion to the page's length, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rasterflux.llm.common import arrow

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not page text.
RAW = frozenset("script style template textarea title svg iframe object canvas select option button annotation annotation-xml".split())
#: Elements that are never part of the article.
OUTSIDE = frozenset("nav footer aside form dialog menu head".split())
#: Elements that flow inside a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mfenced".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
    " details dd dt li".split()
)
#: Words of a class or id that mark what is not article text, and words that say nothing beside them.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr"
    " masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pagination pager popup promo promoted promotion related replies reply respond"
    " share sharing shoutbox sidebar skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
NEUTRAL = frozenset(
    "area articles bar bottom box button buttons block container content form global group header inner item items left link links list main media module outer page panel posts primary"
    " right row secondary section site sticky stories text title top wrap wrapper".split()
)
#: Of the former, those that content also has inside an article.
AMBIGUOUS = frozenset("notice notices".split())
UNLIKELY_ROLE = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split()
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Node:
    __slots__ = ("tag", "parent", "items", "score", "chars", "links", "marks", "skip", "doubt", "mild", "apart", "kept")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []
        self.score = 0.0
        self.chars = self.links = self.marks = 0
        #: Left out; left out unless it reads like prose, or if it is mostly links; a header or in one; part of the result.
        self.skip = self.doubt = self.mild = self.apart = self.kept = False

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0

    def points(self) -> float:
        return self.score * (1 - self.density())


def _judge(node: Node, attrs: str, inside: bool) -> None:
    """Sets skip and doubt; ``inside`` an article or main."""
    tag = node.tag
    # What stands in for scripts inside an article is its text.
    if tag in OUTSIDE or (tag == "noscript" and not inside):
        node.skip = True
        return
    # A header inside the article holds its title.
    node.apart = tag == "header" and not inside
    if not attrs or "=" not in attrs:
        node.skip = bool(attrs and re.search(r"\bhidden\b", attrs))
        return
    if tag in ("html", "body", "article", "main"):
        return
    for name, *value in ATTR.findall(attrs):
        text = "".join(value).lower()
        name = name.lower()
        if name in ("class", "id"):
            for token in text.split():
                words = [w for w in re.split(r"[-_]+", token) if w]
                bad = [w in UNLIKELY for w in words]
                if any(bad):
                    alone = all(b or w in NEUTRAL or w.isdigit() for b, w in zip(bad, words, strict=True))
                    weak = inside and all(w in AMBIGUOUS for b, w in zip(bad, words, strict=True) if b)
                    node.skip |= alone and not weak
                    node.mild |= inside and not alone
                    node.doubt |= not inside or weak
        elif (
            (name == "role" and text in UNLIKELY_ROLE)
            or (name == "aria-hidden" and text == "true")
            or name == "hidden"
            or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", text))
        ):
            node.skip = True


def parse(page: str) -> list[Node]:
    """All elements in page order, the root first."""
    root = node = Node("#root", None)
    nodes, open_ = [root], Counter()
    at, n = 0, len(page)

    def close(last: Node) -> None:
        """Leaves ``last`` and all that is open in it."""
        nonlocal node
        while True:
            open_[node.tag] -= 1
            done, node = node is last, node.parent
            if done:
                return

    while at < n:
        m = TAG.search(page, at)
        if not m:
            if page[at:]:
                node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up: Node | None = node if open_[tag] > 0 else None
            while up and up.tag != tag:
                # An end tag does not close what its own block does not hold.
                up = None if tag in INLINE and up.tag not in INLINE else up.parent
            if up and up.parent:
                close(up)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in ENDS_P and open_["p"] > 0:
            up = node
            while up and (up.tag in INLINE or up.tag == "p"):
                if up.tag == "p":
                    close(up)
                    break
                up = up.parent
        if tag in ("li", "dd", "dt", "tr", "td", "th"):
            same = {"li": ("li",), "tr": ("tr", "td", "th")}.get(tag, ("dd", "dt") if tag in ("dd", "dt") else ("td", "th"))
            stop = ("ul", "ol", "dl", "table", "tbody", "tr") if tag != "tr" else ("table", "tbody")
            up, last = (node if any(open_[x] > 0 for x in same) else None), None
            while up and up.tag not in stop and up.parent:
                if up.tag in same:
                    last = up
                    if tag != "tr" or up.tag == "tr":
                        break
                up = up.parent
            if last:
                close(last)
        child = Node(tag, node)
        _judge(child, m[3], open_["article"] + open_["main"] > 0)
        node.items.append(child)
        nodes.append(child)
        if tag not in VOID and not m[3].endswith("/"):
            node = child
            open_[tag] += 1
    return nodes


def _blocks(node: Node, out: list[tuple[Node, str, int]]) -> None:
    """The text blocks below a node, in page order: (block's node, raw text, characters in links)."""
    parts: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((owner, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    # Depth first without recursion: (node, next item, inside a link)
    stack: list[list] = [[node, 0, False]]
    owner = [node]
    while stack:
        top = stack[-1]
        current, k, link = top
        if k >= len(current.items):
            stack.pop()
            if current.tag not in INLINE:
                flush(owner.pop())
            continue
        top[1] += 1
        item = current.items[k]
        if isinstance(item, str):
            parts.append(item)
            if link:
                linked += len(item)
        elif not item.skip:
            if item.tag in INLINE:
                if item.tag == "br":
                    parts.append(" ")
                stack.append([item, 0, link or item.tag == "a"])
            else:
                flush(owner[-1])
                owner.append(item)
                stack.append([item, 0, False])


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What containers pass on of their points, and the link density from which an element does not read like prose.
PASSED, LINKED = 0.6, 0.3


def _score(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Points, characters, links and end marks of every element, from the leaves up; elements in doubt that are not prose are left out."""
    for owner, text, links in blocks:
        owner.chars += len(text)
        owner.links += links
        owner.marks += sum(map(text.count, ".,!?;。，、"))
        points = 1 + sum(map(text.count, ",，、")) + min(len(text) // 100, 3)
        # A list item's or heading's points reach its container as a paragraph's do.
        inner = owner.tag in ENDS_P and owner.tag not in ("article", "section", "div", "main") and owner.parent
        (owner.parent if inner else owner).score += points
    for node in reversed(nodes):
        if (node.doubt and (node.density() >= LINKED or node.marks == 0)) or (node.mild and node.density() >= LINKED):
            node.skip = True
        if node.parent and not node.skip and not node.apart:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.marks += node.marks
            node.parent.score += PASSED * node.score


#: How lines begin that stand below an article, not in it.
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)


def _belongs(sibling: Node, text: str) -> bool:
    """Whether an element beside the best container is part of the article."""
    if RIGHTS.match(text):
        return False
    if sibling.tag in HEADINGS or sibling.tag in ("p", "blockquote", "pre", "figure"):
        return sibling.density() < LINKED
    return sibling.density() < LINKED and sibling.marks > 0


def _has_heading(node: Node) -> bool:
    return any(isinstance(x, Node) and not x.skip and (x.tag in HEADINGS or _has_heading(x)) for x in node.items)


def extract(page: str | None) -> str:
    """The article of a page, blocks joined by line ends."""
    if not page:
        return ""
    nodes = parse(page)
    blocks: list[tuple[Node, str, int]] = []
    _blocks(nodes[0], blocks)
    if not blocks:
        return ""
    _score(nodes, blocks)
    for node in nodes:
        if node.parent is not None:
            node.skip |= node.parent.skip
            node.apart |= node.parent.apart
    best = max((x for x in nodes if not x.skip and not x.apart), key=Node.points)
    # Around it: boxes that hold nothing more but headings, then the article.
    while (up := best.parent) and up.tag not in ("body", "html", "#root"):
        others = [x for x in up.items if isinstance(x, Node) and x is not best and not x.skip and not x.apart and x.chars]
        if any(x.tag not in HEADINGS or x.density() >= LINKED for x in others):
            break
        best = up
    found, up = best, best
    while up := up.parent:
        if (up.tag == "article" and best is found) or (up.tag in ("article", "main") and 2 * best.chars >= up.chars):
            best = up
    if best is not found:
        # Articles beside the best container that are mostly links are teasers of other pages.
        above = {id(found)}
        up = found
        while up := up.parent:
            above.add(id(up))
        for node in nodes:
            node.skip |= (node.tag == "article" and id(node) not in above and node.density() >= 0.5) or (node.parent is not None and node.parent.skip)
    best.kept = True
    if best.parent and best.tag not in ("article", "main"):
        begins: dict[int, str] = {}
        for owner, text, _ in blocks:
            # The first text of every element beside the best.
            up = owner
            while up and up.parent is not best.parent:
                up = up.parent
            if up:
                begins.setdefault(id(up), text)
        for sibling in best.parent.items:
            if isinstance(sibling, Node) and sibling is not best and not sibling.skip and not sibling.apart and sibling.chars:
                sibling.kept |= _belongs(sibling, begins.get(id(sibling), ""))
    for node in nodes:
        if node.parent is None:
            continue
        if node.tag == "header" and node.apart and not node.parent.apart:
            # In the chosen container, or beside it in its box, a header with a heading is the title; the body's own is the page's.
            own_box = node.parent.tag not in ("body", "html", "#root")
            node.kept = own_box and (node.parent.kept or node.parent is best.parent) and node.density() < LINKED and _has_heading(node)
        else:
            node.kept |= node.parent.kept
    return "\n".join(text for owner, text, _ in blocks if owner.kept and not owner.skip)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                batch.column(1).cast(pa.string()),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points, for every row of ``pages``."""
    return arrow(pages.select("page_id", "url", "html"), _run, "page_id long, url string, text string, n_chars long")
