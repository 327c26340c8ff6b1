"""HTML extraction by a tree-structured graphical model over the DOM.

Every element and text block is content or not. Potentials of its own come from its tag, its
class and id words and, for text, its length, links and punctuation; parent-child potentials
tie a node to its element. Messages passed upward and then downward give each node's exact
marginal; text blocks more likely content than not make the text.

The potentials are counts over labelled pages, summed in Spark. A page labels itself where it
has an article or main element: text in it is content unless it lies in an element that the
standard, or a usual class name, marks as something else; text outside is not. Pages without
such an element label long unlinked paragraphs, and the headings, lists and short lines that
stand beside one. A class name counts as a whole: no-sidebar or related-work names no role, and
neither does any name of an element that holds the article or nearly all text. The two kinds of pages have potentials of their
own: where the article is named, all other elements hold nothing, which says nothing of pages
that are built of plain ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.dom import Node, parse

BUCKETS = 4096  # of class and id words, so that the model's size does not depend on the pages
PRIOR = 1e6
LEAST = 0.001  # probability of either state under either state of the parent
WEAK, STRONG = 1.0, 14.0  # most log odds of a feature: of any, and of one the standard gives a role
# fixed values: elements and class words that are not the article
ASIDE_TAGS = frozenset("nav aside footer form menu search dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
KINDS = ("node", "text", "role", "below")
NAMED, PLAIN = "named ", ""  # kinds of pages, as they lead the names of their potentials
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer "
    "footer form header login masthead menu nav navbar navigation newsletter notice notices notification pagination popup promo promotion related "
    "reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# words that beside an aside word leave its role as it is: comment-list, site-footer, sidebar-left
FILL_WORDS = frozenset(
    "area articles bar block body bottom box buttons col column container content count div form global group holder icons inner item items left "
    "links list media modal module outer page panel posts primary reader right row secondary section site slot stories thread top user wrap wrapper".split()
)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FLOW_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
MOST = 0.8  # share of a page's text that no aside holds


def page_kind(nodes: list[Node]) -> str:
    return NAMED if any(n.tag in MAIN_TAGS for n in nodes) else PLAIN


def _parts(token: str) -> list[str]:
    return [p.lower() for p in PART.findall(token)]


def _says_aside(token: str) -> bool:
    """Whether a whole class, id or role names something beside the article."""
    parts = [p for p in _parts(token) if len(p) > 1 or p in ASIDE_WORDS]
    return not ASIDE_WORDS.isdisjoint(parts) and all(p in ASIDE_WORDS or p in FILL_WORDS for p in parts)


def _says_header(token: str) -> bool:
    return _says_aside(token) and ASIDE_WORDS.intersection(_parts(token)) == {"header"}


def asides(nodes: list[Node]) -> list[bool]:
    """Which elements their tag or a class name sets aside.

    A class name does not where the element is the body, holds the article or main element or, on
    a page without one, holds nearly all text. A header within the article is part of it.
    """
    plain = page_kind(nodes) == PLAIN
    size, holds, main = [len(n.text) for n in nodes], [False] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        holds[p] |= holds[i] or nodes[i].tag in MAIN_TAGS
    out = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        main[i] = main[n.parent] or n.tag in MAIN_TAGS
        if n.tag == "#text":
            continue
        most = plain and size[i] > MOST * size[0]
        if n.tag in ASIDE_TAGS:
            out[i] = not (n.tag == "form" and (holds[i] or most))  # some pages are one form
        elif n.tag not in MAIN_TAGS and n.tag not in ("html", "body") and not holds[i] and not most:
            named = any(_says_aside(t) and not (main[i] and _says_header(t)) for t in n.tokens)
            out[i] = named or (n.tag == "header" and not main[i])
    return out


def _kinds(nodes: list[Node], aside: list[bool]) -> list[str]:
    """Which parent-child potential holds for each node: below an aside, text, an element of a role, or another."""
    below, out = [False] * len(nodes), ["node"] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        below[i] = below[n.parent] or aside[n.parent]
        if below[i]:
            out[i] = "below"
        elif n.tag == "#text":
            out[i] = "text"
        elif aside[i] or n.tag in MAIN_TAGS or n.tag == "header":
            out[i] = "role"
    return out


def _features(node: Node, aside: bool, beside: bool | None = None) -> list[str]:
    """Names of a node's features; words go to buckets."""
    if node.tag == "#text":
        words = node.text.count(" ") + 1
        link = 0 if not node.linked else 1 if 2 * node.linked < len(node.text) else 2
        marks = sum(map(node.text.count, ".!?"))
        stands = [] if beside is None else [f"beside {int(beside)}"]
        return [f"length {min(words.bit_length(), 8)}", f"linked {link}", f"marks {min(marks, 3)}", *stands]
    words = sorted({p for t in node.tokens for p in _parts(t)})
    said = [ASIDE] if aside else [] if node.tag in ASIDE_TAGS else [f"tag {node.tag}"]
    return [*said, *(f"word {zlib.crc32(w.encode()) % BUCKETS}" for w in words)]


ASIDE = "aside"
STRONG_FEATURES = frozenset([ASIDE, *(f"tag {t}" for t in MAIN_TAGS)])


def _long(node: Node) -> bool:
    return node.tag == "#text" and node.text.count(" ") >= 10 and 3 * node.linked < len(node.text)


def _beside(nodes: list[Node]) -> list[bool]:
    """Text in headings, lists, tables and lines of an element in one of whose children long unlinked text stands."""
    long = [_long(n) for n in nodes]
    tells = [False] * len(nodes)
    for i, n in enumerate(nodes):
        if long[i] and n.parent > 0:
            tells[n.parent] = True
            if nodes[n.parent].tag in FLOW_TAGS:
                tells[nodes[n.parent].parent] = True
    beside = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        beside[i] = tells[n.parent] or (beside[n.parent] and nodes[n.parent].tag in FLOW_TAGS)
        if n.tag != "#text" and n.tag not in FLOW_TAGS:
            beside[i] = False
    return beside


def _told(nodes: list[Node]) -> list[bool]:
    """Text of a page without article that its paragraphs show to be content: long unlinked text, and unlinked text beside it."""
    return [_long(n) or (near and n.tag == "#text" and 3 * n.linked < len(n.text)) for n, near in zip(nodes, _beside(nodes), strict=True)]


def _stands(nodes: list[Node]) -> list[bool | None]:
    """On pages without article, whether a node stands beside long text."""
    return [None] * len(nodes) if page_kind(nodes) == NAMED else _beside(nodes)


def labels(nodes: list[Node], set_aside: list[bool] | None = None) -> list[int]:
    """1 content, 0 not, for every node; an element is content if all its text is."""
    set_aside = asides(nodes) if set_aside is None else set_aside
    told = None if page_kind(nodes) == NAMED else _told(nodes)
    main, aside = [False] * len(nodes), [False] * len(nodes)
    out, size, content = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i, n in enumerate(nodes):
        if i:
            main[i] = main[n.parent] or n.tag in MAIN_TAGS
            aside[i] = aside[n.parent] or set_aside[i]
        if n.tag == "#text":
            out[i] = int((told[i] if told else main[i]) and not aside[i])
            size[i], content[i] = len(n.text), len(n.text) * out[i]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        content[p] += content[i]
    return [o if n.tag == "#text" else int(0 < c == s) for n, o, c, s in zip(nodes, out, content, size, strict=True)]


def count(nodes: list[Node], into: Counter) -> None:
    """Add a page's labelled features and parent-child pairs: (kind, state) to times."""
    aside, page = asides(nodes), page_kind(nodes)
    states, kinds, beside = labels(nodes, aside), _kinds(nodes, aside), _stands(nodes)
    for i, n in enumerate(nodes[1:], 1):
        into[f"{page}all text" if n.tag == "#text" else f"{page}all node", states[i]] += 1
        into[f"{page}pair {kinds[i]} {states[n.parent]}", states[i]] += 1
        for f in _features(n, aside[i], beside[i]):
            into[page + f, states[i]] += 1


class TreeModel:
    """Log potentials from counts; smoothed, with what the standard says as earlier evidence."""

    def __init__(self, counts: dict[tuple[str, int], float]):
        total = Counter(counts)
        for page in (NAMED, PLAIN):
            total[f"{page}{ASIDE}", 0] += PRIOR
            for tag in MAIN_TAGS:
                total[f"{page}tag {tag}", 1] += PRIOR
            for kind in ("node", "text"):
                for s in (0, 1):
                    total[f"{page}pair {kind} {s}", s] += 4.0  # a child tends to be what its parent is
            total[f"{page}pair below 0", 0] += 1 / LEAST  # and all the more where that is set aside
            total[f"{page}pair below 1", 1] += 2.0
        self.total = total
        self.known: dict[str, float] = {}

    def odds(self, feature: str, kind: str, page: str = PLAIN) -> float:
        """Log of how much likelier the feature is at content than elsewhere, within bounds:
        pages on which a tag never stood elsewhere do not prove that it never does."""
        name = page + feature
        if name not in self.known:
            one, zero = ((self.total[name, s] + 0.5) / (self.total[f"{page}all {kind}", s] + 1.0) for s in (1, 0))
            seen = self.total[name, 0] + self.total[name, 1]
            most = STRONG if feature in STRONG_FEATURES else WEAK
            self.known[name] = max(-most, min(most, math.log(one / zero))) if seen else 0.0
        return self.known[name]

    def pair(self, kind: str, page: str = PLAIN) -> list[list[float]]:
        """P(child state | parent state)."""
        rows = [[self.total[f"{page}pair {kind} {p}", s] + 0.5 for s in (0, 1)] for p in (0, 1)]
        ones = [min(1 - LEAST, max(LEAST, r[1] / sum(r))) for r in rows]
        return [[1 - one, one] for one in ones]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node by sum-product: leaves to root, then root to leaves."""
        page = page_kind(nodes)
        pairs = {k: self.pair(k, page) for k in KINDS}
        aside = asides(nodes)
        kinds, beside = _kinds(nodes, aside), _stands(nodes)
        up = [[1.0, 1.0] for _ in nodes]  # evidence at and below a node, by state
        to_parent: list[list[float]] = [[1.0, 1.0] for _ in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            n = nodes[i]
            weight = sum(self.odds(f, "text" if n.tag == "#text" else "node", page) for f in _features(n, aside[i], beside[i]))
            e = math.exp(max(-30.0, min(30.0, weight)))
            a, b = up[i][0], up[i][1] * e
            a, b = a / (a + b), b / (a + b)
            up[i] = [a, b]
            t = pairs[kinds[i]]
            to_parent[i] = [t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b]
            parent = up[n.parent]
            parent[0] *= to_parent[i][0]
            parent[1] *= to_parent[i][1]
            scale = parent[0] + parent[1]
            parent[0] /= scale
            parent[1] /= scale
        belief = [[0.5, 0.5] for _ in nodes]
        belief[0] = [up[0][0] / sum(up[0]), up[0][1] / sum(up[0])]
        for i in range(1, len(nodes)):
            p = nodes[i].parent
            # what the parent knows without this child
            w0, w1 = belief[p][0] / max(to_parent[i][0], 1e-300), belief[p][1] / max(to_parent[i][1], 1e-300)
            t = pairs[kinds[i]]
            a, b = up[i][0] * (w0 * t[0][0] + w1 * t[1][0]), up[i][1] * (w0 * t[0][1] + w1 * t[1][1])
            belief[i] = [a / (a + b), b / (a + b)]
        return [b for _, b in belief]

    def text(self, page: str | None) -> str:
        nodes = parse(page or "")
        return "\n".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.tag == "#text" and p > 0.5)


def learn(pages: DataFrame, html_col: str = "html") -> TreeModel:
    """Potentials from all pages; null and empty pages count nothing."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                count(parse(page.as_py() or ""), into)
        if into:
            kinds, states = zip(*into, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(states, pa.int32()), pa.array([float(x) for x in into.values()])], ["kind", "state", "n"])

    rows = pages.select(F.col(html_col).alias("html")).mapInArrow(counted, "kind string, state int, n double")
    sums = rows.groupBy("kind", "state").agg(F.sum("n").alias("n"))
    return TreeModel({(r["kind"], r["state"]): r["n"] for r in sums.collect()})  # bounded by block tags and buckets


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages; text is empty if none is content.

    Null and empty html give empty text; repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """
    model = learn(pages, html_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
