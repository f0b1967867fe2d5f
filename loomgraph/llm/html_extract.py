"""HTML extraction: flat text blocks, classified by a decision tree on words and links around them.

A page becomes a flat list of text blocks. Each has its number of words, its link density, those of
the block before and the block after, and marks of the elements around it (a heading, an article, a
navigation, an advert, ...). A decision tree of Gini splits, grown at first use from the small table
of labelled pages below, keeps a block or drops it. Labelled pages are learned from twice, as they
are and without marks, so the tree judges blocks by words and links where a page has no such elements
or names. A page of which nothing is kept is judged again without marks.

Scripts, styles and the like never make text. Character references are decoded, white space inside
a block becomes one space, blocks are trimmed, empty ones go, and kept blocks are joined in page
order by one line feed.

Marks: the nearest element that says something counts. Elements as ``nav`` and names as ``comments``
(STICKY) hold for all that is inside of them; other names end where an article, a ``main`` or an
element with a name as ``content`` begins. Names that describe a page's layout or subject
(``has-sidebar``, ``category-legal``) say nothing.

Defined results: a null or empty html, or one without a kept block, gives an empty text. Markup that
is broken, unclosed or cut off is read as far as it goes. Rows are independent: repeated rows, ties
and null ids keep their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "picture", "source", "nobr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
MAIN_TAGS = {"article", "main"}
CHROME_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "head"}
# Words of class, id and role that name what isn't the article, and what is.
CHROME_WORDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "rail", "widget",
    "banner", "promo", "notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search",
    "share", "sharing", "social", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "alert", "contentinfo", "complementary", "skip", "tags", "subscription", "foot", "side",
}
STICKY = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "related", "recommended", "teaser",
}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story"}
#: First parts of names that describe a page and don't name an element's role.
DESCRIBING = {"has", "with", "no", "is", "category", "tag", "type", "format", "status", "theme", "js"}

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "chrome", "main", "heading")
MARKS = slice(6, 8)

# The labelled pages, one a line. A block has its label (1 for text, 0 for the rest), its words, its
# link density and its marks: c for chrome, m for main, h for a heading, - for none. The first six are
# pages of the table of web pages; the others are of other layouts. A page that starts with = can be
# told by its marks only, and isn't learned from without them.
LABELLED = """
0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 8 0 c | 1 14 0 mh | 1 35 0 m | 1 17 0 m | 1 49 0 m | 1 143 0 m | 0 11 0 c
0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 9 0 c | 1 7 0 mh | 1 11 0 m | 1 231 0 m | 1 59 0 m | 1 123 0 m | 0 7 0 c
0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 7 0 c | 1 11 0 mh | 1 20 0 m | 1 61 0 m | 0 13 0 c
0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 5 0 c | 1 11 0 mh | 1 31 0 m | 1 8 0 m | 1 21 0 m | 0 11 0 c
0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 5 0 c | 1 10 0 mh | 1 17 0 m | 1 29 0 m | 1 30 0 m | 0 12 0 c
0 1 1 c | 0 1 1 c | 0 1 1 c | 0 1 1 c | 0 6 0 c | 1 11 0 mh | 1 50 0 m | 0 15 0 c
0 3 1 c | 0 1 1 c | 0 2 1 c | 1 9 0 mh | 0 6 .4 c | 1 54 0 m | 1 41 .05 m | 1 12 0 m | 1 63 .1 m | 0 18 0 c | 0 25 0 c | 0 31 0 c | 0 9 .5 c
0 12 0 c | 0 4 1 c | 1 7 0 mh | 1 88 0 m | 1 3 0 mh | 1 47 .04 m | 1 1 0 m | 1 2 0 m | 1 5 .6 m | 0 22 0 c | 0 2 1 c | 0 16 0 c
0 2 1 - | 0 1 1 - | 0 3 1 - | 0 2 1 - | 1 8 0 h | 1 60 0 - | 1 35 .1 - | 1 6 0 - | 1 72 0 - | 0 5 .8 - | 0 3 1 - | 0 11 .2 -
0 1 1 c | 0 2 1 c | 0 7 0 c | 1 11 0 mh | 1 33 0 m | 1 2 0 m | 1 19 0 m | 0 14 0 c | 1 26 0 m | 1 58 .2 m | 0 40 0 c | 0 52 0 c
0 5 .9 - | 0 4 1 - | 0 6 0 - | 1 10 0 h | 1 120 .02 - | 1 95 0 - | 1 14 0 - | 1 44 0 - | 0 3 1 - | 0 4 1 - | 0 8 .3 -
1 66 0 m | 1 21 0 m | 1 4 0 m | 1 39 .1 m
1 1 0 - | 1 30 0 - | 1 45 .1 -
1 12 0 - | 0 2 1 - | 0 2 1 -
1 5 0 - | 1 3 0 -
1 9 0 mh | 1 48 0 m | 1 33 0 m
1 8 0 h | 1 44 0 - | 1 52 0 -
1 10 0 h | 1 90 0 - | 1 30 0 - | 1 24 0 -
1 50 0 - | 1 70 .05 -
0 4 .9 - | 1 9 0 h | 1 38 0 - | 1 27 0 - | 1 41 0 -
= 1 7 0 mh | 1 60 0 m | 1 12 0 m
= 1 66 0 m | 1 90 .1 m | 1 3 0 m
= 0 3 1 c | 1 8 0 mh | 1 40 0 m | 1 8 0 m
= 0 2 1 c | 0 1 1 c | 1 6 0 mh | 1 77 0 m | 1 52 0 m | 1 15 0 m
= 0 1 1 c | 0 9 0 c | 1 7 0 m | 1 5 1 m | 1 2 0 m | 1 6 .5 m | 1 4 1 m
= 0 6 0 c | 1 9 0 mh | 1 20 1 m | 1 35 0 m | 1 22 .4 m | 1 50 0 m | 1 8 1 m | 1 5 0 m | 1 60 .2 m | 1 18 0 m | 0 11 0 c
= 1 14 .3 m | 1 3 0 m | 1 28 .2 m | 1 12 0 m | 1 6 .6 m | 1 2 0 m | 1 1 0 m | 1 9 1 m | 1 45 0 m | 1 7 0 m
0 1 1 - | 1 8 0 h | 1 30 .3 - | 1 40 0 - | 1 25 .5 - | 1 33 0 - | 0 10 0 -
= 0 3 1 c | 0 2 1 c | 1 2 0 mh | 1 7 0 m | 1 8 0 m | 1 12 0 m | 0 9 0 c
= 0 5 1 - | 1 4 0 mh | 1 6 0 m | 1 5 0 m | 1 3 0 mh | 1 2 0 m
= 0 1 1 c | 1 2 0 mh | 1 4 0 m | 1 1 0 m
= 1 1 1 m | 1 30 .5 m | 1 12 1 m | 1 40 .3 m | 0 5 1 c | 0 30 0 c | 0 80 0 c | 0 45 .1 c
"""


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    chrome: int
    main: int
    heading: int


TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*)?((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: What an element says: nothing, main, chrome that an article in it ends, chrome for all in it.
PLAIN, MAIN, CHROME, HELD = range(4)


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> int:
    """What an element's name and its class, id and role say of it."""
    if tag in ("body", "html"):  # their marks are those of the whole page
        return PLAIN
    names, hidden = [], False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            names += value.split()
        hidden |= name == "hidden" or name == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none", value, re.I) is not None
    parts = [[w.lower() for w in PART.findall(x)] for x in names]
    parts = [x for x in parts if x and x[0] not in DESCRIBING]
    words = {w for x in parts for w in x}
    whole = {x[0] for x in parts if len(x) == 1}
    if hidden or tag in CHROME_TAGS or words & STICKY:
        return HELD
    if tag in MAIN_TAGS or whole & MAIN_WORDS and not whole & CHROME_WORDS:
        return MAIN
    if words & CHROME_WORDS:
        return CHROME
    return MAIN if words & MAIN_WORDS else PLAIN


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, what holds in it, whether it is in a heading
    parts: list[str] = []
    linked = total = anchors = 0

    def flush() -> None:
        nonlocal parts, linked, total
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                _, kind, heading = stack[-1] if stack else ("", PLAIN, 0)
                out.append(Block(text, text.count(" ") + 1, linked / total if total else 0.0, int(kind >= CHROME), int(kind == MAIN), heading))
        parts, linked, total = [], 0, 0

    def say(text: str) -> None:
        nonlocal linked, total
        parts.append(text)
        n = len(text) - text.count(" ")
        total += n
        if anchors:
            linked += n

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if m[0] == "<":
            say("<")
            continue
        if m[1] in ("!", "?") or m[0].startswith("<!--"):
            continue
        if not tag:
            if m[1] != "/":
                say("<")
                at = m.start() + 1
            continue
        if m[1] == "/":
            if tag == "a":
                anchors = 0
            if tag in INLINE:
                continue
            if any(x[0] == tag for x in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "a":
            anchors = 1
        if tag == "br":
            say(" ")
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        kind = _kind(tag, m[3] or "")
        _, over, heading = stack[-1] if stack else ("", PLAIN, 0)
        if tag == "header" and over != MAIN and kind == PLAIN:
            kind = CHROME
        if over == HELD or kind == PLAIN:
            kind = over
        stack.append((tag, kind, int(tag in HEADINGS) | heading))
    flush()
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    """(blocks, FEATURES): a block's own words and link density, its neighbours' (-1 at an end of the page), and its marks."""
    own = np.array([(b.words, b.link_density) for b in blocks], float).reshape(-1, 2)
    pad = np.full((1, 2), -1.0)
    marks = np.array([(b.chrome, b.main, b.heading) for b in blocks], float).reshape(-1, 3)
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), marks])


def without_marks(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, MARKS] = 0
    return x


def labelled_pages() -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of each labelled page, and of most once more without marks."""
    out = []
    for line in LABELLED.strip().split("\n"):
        rows = [r.split() for r in line.removeprefix("=").split("|")]
        x = features_of([Block("", int(n), float(d), int("c" in f), int("m" in f), int("h" in f)) for _, n, d, f in rows])
        y = np.array([r[0] == "1" for r in rows])
        out += [(x, y)] if line.startswith("=") else [(x, y), (without_marks(x), y)]
    return out


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2) -> Node:
    """A decision tree of Gini splits; ties go to the first feature and the lowest cut."""
    node = Node(label=bool(y.mean() >= 0.5))
    if depth == 0 or y.all() or not y.any() or len(y) < 2 * least:
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            a, b = y[low], y[~low]
            if len(a) < least or len(b) < least:
                continue
            score = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut)
    if best is None:
        return node
    _, node.feature, node.cut = best
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


@lru_cache(maxsize=1)
def tree() -> Node:
    x, y = zip(*labelled_pages())
    return grow(np.vstack(x), np.concatenate(y))


def classify(x: np.ndarray, node: Node | None = None) -> np.ndarray:
    node = node or tree()
    if node.low is None:
        return np.full(len(x), node.label)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(x[low], node.low), classify(x[~low], node.high)
    return out


def extract_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    x = features_of(blocks)
    kept = classify(x)
    if not kept.any():
        kept = classify(without_marks(x))
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract_text(h) for h in batch.column("html").to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row's whole html."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_extract, schema)
