"""Main text of web pages by composite text density.

A page is parsed into a DOM with the usual implied end tags. Elements that by their tag hold no
article text (nav, header, footer, aside, form, script, style and the like, roles of the same
meaning) are empty. For every node the composite text density is characters per tag, adjusted
for links (Sun, Song & Liao, 2011):

    density = C/T * log_b(C/LC * T/LT),  b = ln(C*LC/(C-LC) + C*LCb/Cb + e)

with C characters, T tags (formatting such as b or br does not count), LC and LT those of
links, b the body, and counts of 0 as 1; 0 where all text is links. The threshold is the
smallest density on the path from the body to the densest node; among the nodes at or above
it, the one with the largest sum of its children's densities is the article. A part of an
article (a paragraph, a list) is widened to the element that holds it.

Within the article densities tell boilerplate by place: containers (not paragraphs, headings,
tables or quotes) below the threshold (directly in the body also those below a quarter of the
largest density) before the first or after the last part that reaches it go, and so do lists,
containers and loose text anywhere that are mostly links. What density cannot tell, a part that
reads like the article but is none of it (an advert, a notice, reader comments), goes by its
name before densities are computed: an element one of whose class names, or whose id, is made
of nothing but words for such parts (``ad``, ``cookie-notice``, ``comment-list``, but not
``notice-board`` or ``share-price``), unless the page has no other text. All other
text is returned, one line per block.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import trimmed

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe object embed canvas svg math audio video button select option textarea input menu dialog title xmp noembed noframes".split())
PART_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar widget widgets comment comments commentary respond disqus replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar copyright".split())
FILLER_WORDS = frozenset("area bar block bottom box button buttons container content form inner item items left links list main msg message page panel right row section site slot text thread top unit wrap wrapper the of and user users reader readers my".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SOLID = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table dl figure figcaption tr td th dt dd caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
WHOLE = frozenset("html body main article div td".split())
LOOSE = frozenset("html body main article section div ul ol td".split())
BOUNDARY = frozenset("html body article section div main table td th ul ol dl blockquote aside nav header footer form figure details fieldset".split())

TOKEN = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)|/(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "named", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.dropped, self.named = (tag in DROPPED, False) if "=" not in attrs else by_names(tag, attrs)
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def by_names(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element holds no article text by its tag or role, and whether its class or id names nothing but another part."""
    dropped, named = tag in DROPPED, False
    if tag in ("html", "body", "main", "article"):
        return False, False
    for name, value in NAMED.findall(attrs):
        value = html.unescape(value.strip("\"'"))
        if name.lower() == "role":
            dropped |= value.strip().lower() in DROPPED_ROLES
        else:
            named |= any(names_part(token) for token in value.split())
    return dropped, named


def names_part(token: str) -> bool:
    words = [w.lower() for w in WORDS.findall(token) if not w.isdigit()]
    return any(w in PART_WORDS for w in words) and all(w in PART_WORDS or w in FILLER_WORDS for w in words)


class Stack:
    """The open elements. ``frames`` counts the open tags from each boundary element on, so that looking for one that is not open costs nothing."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.hidden = [root], 0
        self.frames: list[Counter] = [Counter([root.tag])]
        self.open = Counter([root.tag])

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        if node.tag in BOUNDARY:
            self.frames.append(Counter())
        self.frames[-1][node.tag] += 1
        self.open[node.tag] += 1
        self.hidden += node.dropped

    def close(self, i: int) -> None:
        """Pops the elements from place i on."""
        while len(self.nodes) > i:
            node = self.nodes.pop()
            self.frames[-1][node.tag] -= 1
            self.open[node.tag] -= 1
            if node.tag in BOUNDARY:
                self.frames.pop()
            self.hidden -= node.dropped

    def close_implied(self, tag: str, closes: frozenset | set) -> None:
        """The end tags that the start of this element implies, up to the nearest boundary."""
        while any(self.frames[-1][name] for name in closes):
            i = len(self.nodes) - 1
            while self.nodes[i].tag not in closes:
                i -= 1
            if i == 0:
                return
            self.close(i)
            if tag not in ("tr", "thead", "tbody", "tfoot"):
                return

    def close_named(self, tag: str) -> None:
        """An end tag: formatting closes up to the nearest boundary only."""
        if (self.frames[-1] if tag in INLINE else self.open)[tag]:
            i = len(self.nodes) - 1
            while self.nodes[i].tag != tag:
                i -= 1
            if i:
                self.close(i)


def parse(page: str) -> Node:
    """The tree of a page; dropped elements stay as empty leaves. Linear in the page."""
    root = Node("html", None)
    stack, at, text = Stack(root), 0, page.replace("\0", "")

    def say(s: str) -> None:
        if s and not stack.hidden:
            stack.nodes[-1].parts.append(html.unescape(s))

    while m := TOKEN.search(text, at):
        say(text[at : m.start()])
        at = m.end()
        tag, attrs = m["open"] or m["loose"], m["attrs"] or m["rest"] or ""
        if tag:
            tag = tag.lower()
            if tag in RAW:
                end = RAW_END[tag].search(text, at) if tag != "plaintext" else None
                at = end.end() if end else len(text)
                continue
            if tag in ("html", "body") and (tag == "html" or stack.open["body"]):
                continue
            if tag == "body":
                stack.close(1)
            closes = CLOSES.get(tag) or ({"p"} if tag not in INLINE else None)
            if closes:
                stack.close_implied(tag, closes)
            node = Node(tag, stack.nodes[-1], attrs)
            if not stack.hidden:
                stack.nodes[-1].parts.append(node)
            if tag not in VOID and (not attrs.rstrip().endswith("/") or tag in BOUNDARY or tag not in ("path", "g")):
                stack.push(node)
        elif m["close"]:
            tag = m["close"].lower()
            if tag == "br":
                say(" ")
            elif tag not in ("html", "body"):
                stack.close_named(tag)
    say(text[at:])
    return next((p for p in root.parts if isinstance(p, Node) and p.tag == "body"), root)


def ordered(body: Node, with_named: bool) -> list[Node]:
    """The kept nodes, parents first; those named as another part become dropped unless asked for."""
    out, todo = [], [body]
    while todo:
        n = todo.pop()
        out.append(n)
        for p in n.parts:
            if isinstance(p, Node) and p.named and not with_named:
                p.dropped = True
        todo.extend(p for p in reversed(n.parts) if isinstance(p, Node) and not p.dropped)
    return out


def composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite text density of characters, tags and those of links; share: link characters of the body over its characters."""
    if c <= lc:
        return 0.0
    t, lc, lt = max(1, t), max(1, lc), max(1, lt)
    base = math.log(c * lc / max(1, c - lc) + c * share + math.e)
    return c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base)


def measure(nodes: list[Node]) -> None:
    """Character, tag and link counts, then the composite density, of every node."""
    for n in reversed(nodes):
        n.chars += sum(len(" ".join(p.split())) for p in n.parts if isinstance(p, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n is not nodes[0]:
            up = n.parent
            up.chars, up.tags = up.chars + n.chars, up.tags + n.tags + (n.tag not in INLINE or n.tag == "a")
            up.link_chars, up.link_tags = up.link_chars + n.link_chars, up.link_tags + n.link_tags
    share = max(1, nodes[0].link_chars) / max(1, nodes[0].chars)
    for n in nodes:
        n.density = composite(n.chars, n.tags, n.link_chars, n.link_tags, share)


def article(nodes: list[Node]) -> tuple[Node, float, float]:
    """The node with the largest density sum among those that reach the threshold of the path to the densest node, that threshold, and the largest density.

    A part of an article (a paragraph, list, section) is widened to what holds it, and any
    choice inside an article or main element that reaches the threshold to that element.
    """
    body = nodes[0]
    able = [n for n in nodes if n.tag not in INLINE]
    densest = max(able, key=lambda n: n.density)
    threshold, n = densest.density, densest
    while n is not body:
        n = n.parent
        threshold = min(threshold, n.density)
    children = lambda n: sum(p.density for p in n.parts if isinstance(p, Node) and not p.dropped and p.tag not in INLINE)
    best = max((n for n in able if n.density >= threshold), key=children)
    while best.tag not in WHOLE and best is not body:
        best = best.parent
    n = best
    while n is not body:
        if n.tag in ("article", "main") and n.density >= threshold:
            best = n
        n = n.parent
    return best, threshold, densest.density


def mostly_links(n: Node) -> bool:
    return n.link_chars > 0 and 2 * n.link_chars >= n.chars


def prune(top: Node, threshold: float, largest: float) -> set[Node]:
    """What is left out within the article."""
    out: set[Node] = set()
    todo = [top]
    while todo:
        n = todo.pop()
        own = [p for p in n.parts if isinstance(p, Node) and not p.dropped]
        for p in own:
            if p.tag not in INLINE and p.tag not in SOLID and mostly_links(p):
                out.add(p)
        todo += [p for p in own if p not in out]
    # edges: from the article down into its only dense part, containers before and after the dense ones
    n = top
    while n is not None:
        parts = [p for p in n.parts if isinstance(p, Node) and not p.dropped and p.tag not in INLINE and p not in out and p.chars]
        least = max(threshold, largest / 4) if n.tag in ("html", "body") else threshold
        solid = [i for i, p in enumerate(parts) if p.tag in SOLID or p.density >= least]
        dense = [i for i, p in enumerate(parts) if p.density >= least]
        if dense:
            out.update(p for i, p in enumerate(parts) if (i < solid[0] or i > solid[-1]) and p.density < least)
        n = parts[dense[0]] if len(dense) == 1 and len(solid) == 1 and parts[dense[0]].tag not in SOLID else None
    return out


def blocks(top: Node, left_out: set[Node] = frozenset()) -> list[str]:
    """Text of the blocks under a node in page order, white space collapsed, empty blocks left out.

    Loose text of a container, if mostly links, is left out too.
    """
    out: list[str] = []
    held: list[tuple[str, bool]] = []  # pieces, and whether inside a link

    def end(loose: bool) -> None:
        if line := " ".join("".join(t for t, _ in held).split()):
            linked = sum(len(t.strip()) for t, a in held if a)
            if not (loose and linked and 2 * linked >= len(line)):
                out.append(line)
        held.clear()

    todo: list = [(top, False, False)]
    inside = [top]
    while todo:
        n, after, link = todo.pop()
        if isinstance(n, str):
            held.append((n, link))
        elif after:
            end(n.tag in LOOSE)
            inside.pop()
        elif n.tag in ("br", "wbr"):
            held.append((" " if n.tag == "br" else "", link))
        elif not n.dropped and n not in left_out:
            if n.tag not in INLINE:
                end(inside[-1].tag in LOOSE)
                inside.append(n)
                todo.append((n, True, link))
            todo.extend((p, False, link or n.tag == "a") for p in reversed(n.parts))
    end(False)
    return out


def main_text(page: str | None) -> str:
    """The article of a page as lines; empty for null, empty and text-less pages."""
    if not page:
        return ""
    for with_named in (False, True):
        nodes = ordered(parse(page), with_named)
        measure(nodes)
        if nodes[0].chars:
            top, threshold, largest = article(nodes)
            return "\n".join(blocks(top, prune(top, threshold, largest)))
    return ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row per input row; nothing is shuffled.

    Null html counts as empty; null ids and urls stay null; repeated rows give repeated rows;
    very long and deep pages take time in proportion to their size; extra columns are ignored;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
