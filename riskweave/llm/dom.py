"""A tolerant HTML parser that keeps what extraction needs: block elements, their attributes' tokens, and
their text, in page order. Inline markup is no node; its text belongs to the block around it. Its time is linear
in the page: every open element knows its place, so none is searched for, and a page with a quote that is never
closed has its further tags end at the first `>`."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of HTML: elements without content, elements whose content is no markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html head legend li main menu nav ol p pre search section select summary table tbody td tfoot th thead tr ul button svg audio video object".split()
)
#: Block elements that only hold other blocks: text right in them is a block of its own.
CONTAINER = frozenset("body html article aside details dialog div dl fieldset figure footer form header main menu nav ol search section table tbody tfoot thead tr ul center".split())
#: Blocks that a start tag of the key closes when they are open, up to the nearest of the barriers.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Blocks that are never text of a page.
NEVER = frozenset("head select button svg audio video object".split())

_MARKUP = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag up to its end, over quoted values; possessive, so it never goes back.
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label", "rel"))
_SPACES = re.compile(r"\s+")
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str] = field(default_factory=list)
    hidden: bool = False
    #: the training label's mark, None where the element has none
    mark: str | None = None
    text: str = ""
    link_chars: int = 0
    links: int = 0
    controls: int = 0
    images: int = 0


def attributes(node: Node, raw: str) -> None:
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in _NAMED:
            node.tokens += [t.lower() for t in _TOKEN.findall(html.unescape(value))]
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            node.hidden = True
        elif name == "style":
            node.hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "data-keep":
            node.mark = value


class _Open:
    """The open elements, with the places of each kind, so that the innermost of a kind is found at once."""

    def __init__(self):
        #: (tag, node) for blocks, (tag, -1) for inline ones
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = 0

    def push(self, tag: str, node: int = -1) -> None:
        at = len(self.stack)
        self.stack.append((tag, node))
        self.places.setdefault(tag, []).append(at)
        if node >= 0:
            self.blocks.append(at)
        elif tag == "a":
            self.links += 1

    def close_from(self, k: int) -> None:
        """Close all elements from place k on."""
        while len(self.stack) > k:
            tag, node = self.stack.pop()
            self.places[tag].pop()
            if node >= 0:
                self.blocks.pop()
            elif tag == "a":
                self.links -= 1

    def innermost(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def within(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> int:
        """The innermost of `tags` with none of `barriers` inside it, or -1."""
        k = self.innermost(tags)
        return k if k > max(0, self.innermost(barriers)) else -1

    @property
    def block(self) -> int:
        return self.stack[self.blocks[-1]][1]


def parse(page: str) -> list[Node]:
    """Blocks in page order; the first is the root. A node's text has single spaces and no ends."""
    nodes = [Node("html", -1, 0)]
    open_ = _Open()
    open_.push("html", 0)
    parts: list[str] = []
    linked = 0
    lenient = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                owner = open_.block
                # text of a container, or after a child block, is a block of its own
                if nodes[owner].tag in CONTAINER or nodes[owner].text or len(nodes) - 1 != owner:
                    nodes.append(Node("#text", owner, nodes[owner].depth + 1))
                    owner = len(nodes) - 1
                nodes[owner].text = text
                nodes[owner].link_chars = min(linked, len(text))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if open_.links > 0:
            linked += len(text.strip())

    pos, end = 0, len(page)
    while pos < end:
        m = _MARKUP.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            close = page.find(mark, m.end())
            pos = end if close < 0 else close + len(mark)
            continue
        stop = page.find(">", m.end()) if lenient else _REST.match(page, m.end()).end()
        if not lenient and stop < end and page[stop] != ">":  # a quote that nothing closes
            lenient = True
            stop = page.find(">", m.end())
        if stop < 0 or stop >= end:
            break  # cut off inside a tag
        closing, tag, raw = bool(m[1]), m[2].lower(), page[m.end() : stop]
        pos = stop + 1
        if closing:
            if tag in BLOCK:
                flush()
                k = open_.within((tag,), ())
            else:
                k = open_.innermost((tag,))
                k = k if k > open_.blocks[-1] else -1
            if k > 0:
                open_.close_from(k)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.IGNORECASE).search(page, pos)
            stop = page.find(">", close.end()) if close else -1
            pos = end if stop < 0 else stop + 1
            if tag == "textarea":
                nodes[open_.block].controls += 1
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            elif tag == "input":
                nodes[open_.block].controls += 1
            elif tag == "img":
                nodes[open_.block].images += 1
            continue
        if tag in BLOCK:
            flush()
            if tag == "html":
                attributes(nodes[0], raw)
                continue
            if tag not in ("td", "th", "tr", "li", "tbody", "thead", "tfoot", "caption"):
                k = open_.within(("p",), ("table", "td", "th", "button", "object", "caption"))
                if k > 0:
                    open_.close_from(k)
            if tag in CLOSES:
                k = open_.within(*CLOSES[tag])
                if k > 0:
                    open_.close_from(k)
            if tag in _HEADS and open_.stack[-1][0] in _HEADS:
                open_.close_from(len(open_.stack) - 1)
            owner = open_.block
            node = Node(tag, owner, nodes[owner].depth + 1)
            if raw.strip(" /"):
                attributes(node, raw)
            if tag in ("button", "select"):
                nodes[owner].controls += 1
            nodes.append(node)
            if not raw.endswith("/") or tag != "svg":
                open_.push(tag, len(nodes) - 1)
        else:
            open_.push(tag)
            if tag == "a":
                nodes[open_.block].links += 1
    flush()
    return nodes
