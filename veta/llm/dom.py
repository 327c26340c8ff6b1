"""A small tolerant reader of HTML: elements and text blocks as a tree in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![-\w])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
BLANKS = re.compile(r"\s+")
# fixed values: names of elements by their role in the HTML standard
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript title textarea iframe object svg math select datalist audio video canvas noembed noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"html", "body"}
CLOSES = {  # an element that ends an open one of these kinds, up to the nearest of the stops
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}


@dataclass
class Node:
    """An element, or a text block (tag "#text"); parents come before their children."""

    tag: str
    parent: int
    tokens: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0  # characters of the text inside links
    children: list[int] = field(default_factory=list)


def _tokens(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(sorted({t for _, v in ATTRIBUTE.findall(attributes) for t in v.strip("\"'").split()}))


def parse(page: str) -> list[Node]:
    """Nodes of a page; unclosed elements end with their parent, stray end tags are passed over."""
    nodes = [Node("#root", -1)]
    open_: list[tuple[str, int]] = [("#root", 0)]  # inline elements carry their block's number
    pieces: list[str] = []
    linked = links = silent = 0

    def flush() -> None:
        nonlocal linked
        text = BLANKS.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            block = open_[-1][1]
            nodes.append(Node("#text", block, (), text, min(linked, len(text))))
            nodes[block].children.append(len(nodes) - 1)
        pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        """End all elements from this depth on."""
        nonlocal links, silent
        if any(t in BLOCKS for t, _ in open_[depth:]):
            flush()
        for t, _ in open_[depth:]:
            links -= t == "a"
            silent -= t in SILENT
        del open_[depth:]

    def above(kinds: frozenset, stops: frozenset) -> int | None:
        """Depth of the outermost open element of these kinds below the nearest stop."""
        found = None
        for depth in range(len(open_) - 1, 0, -1):
            tag = open_[depth][0]
            if tag in kinds:
                found = depth
            elif tag in stops:
                break
        return found

    def said(text: str) -> None:
        nonlocal linked
        if text and not silent:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        mark = MARK.search(page, at)
        if mark is None:
            said(page[at:])
            break
        said(page[at : mark.start()])
        at = mark.end()
        tag = mark[2].lower() if mark[2] else ""
        if not tag:
            continue
        if mark[1]:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][0] == tag:
                    close(depth)
                    break
                if tag not in BLOCKS and tag not in SILENT and open_[depth][0] in BLOCKS:
                    break  # an inline end tag does not reach out of its block
            continue
        if tag in ENDS_P and (depth := above(frozenset({"p"}), BLOCKS - {"p"})) is not None:
            close(depth)
        if tag in CLOSES and (depth := above(*CLOSES[tag])) is not None:
            close(depth)
        if tag in VOID:
            if tag == "hr":
                flush()
            said(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        block = open_[-1][1]
        if tag in BLOCKS:
            flush()
            nodes.append(Node(tag, block, _tokens(mark[3] or "")))
            nodes[block].children.append(len(nodes) - 1)
            block = len(nodes) - 1
        open_.append((tag, block))
        links += tag == "a"
        silent += tag in SILENT
    close(1)
    flush()
    return nodes
