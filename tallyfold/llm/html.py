"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block elements. Each block gets a score
from its place (the elements and class names above it), its links, its length
and its punctuation; the costs of the two labels are the capacities of its
edges to the terminals. Blocks that follow each other, and blocks whose
closest common element is near, are joined by smoothness edges. The minimum
cut, found by maximum flow, labels all blocks of a page at once.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import bounded_batches

# Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template title textarea select svg math iframe object button canvas audio video map".split())
# Elements that end a block.
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2"
    " h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element that an opening tag closes when it is the innermost one.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
# Elements, roles and words of class names or ids that mark boilerplate, and those that mark content.
BAD_TAGS = frozenset("nav footer aside form menu dialog search head fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " sidebar sidebars comment comments disqus reply replies share sharing social related recommended menu menus nav navbar navigation breadcrumb"
    " breadcrumbs footer header masthead topbar newsletter subscribe subscription popup modal overlay widget widgets login signin signup register"
    " copyright legal disclaimer pagination pager skip toolbar feedback form search".split()
)
GOOD_TAGS = frozenset(("article", "main"))
GOOD_WORDS = frozenset("article content post entry story main text prose".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    good: bool
    bad: bool


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    linked: int


def _element(tag: str, attributes: str, parent: Element | None) -> Element:
    good = tag in GOOD_TAGS or (parent is not None and parent.good)
    bad = tag in BAD_TAGS or (parent is not None and parent.bad)
    if tag == "header" and not good:
        bad = True
    if attributes and tag not in ("html", "body"):
        words: set[str] = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if name.lower() == "role":
                bad |= value.lower() in BAD_ROLES
                good |= value.lower() == "main"
            else:
                words.update(w.lower() for w in _WORD.findall(value))
        # An element that is marked as content and something else holds content.
        marked = bool(words & GOOD_WORDS) and tag != "aside"
        if words & BAD_WORDS and not (marked and not words & {"comment", "comments", "ad", "ads", "related"}):
            bad |= tag != "main"
        elif marked:
            good = True
        if _HIDDEN.search(attributes):
            bad = True
    return Element(tag, parent, parent.depth + 1 if parent else 0, good, bad)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with the element that holds each."""
    root = Element("", None, 0, False, False)
    at, open_links = root, 0
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, at, linked))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if open_links:
            linked += len(text)

    place, size = 0, len(page)
    while place < size:
        found = _TOKEN.search(page, place)
        if found is None:
            add(page[place:])
            break
        if found.start() > place:
            add(page[place : found.start()])
        place = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            open_links = 0 if found[1] else 1
        if tag == "br":
            pieces.append(" ")
        if found[1]:
            if tag in BLOCK:
                flush()
                holder = at
                while holder.parent is not None and holder.tag != tag:
                    holder = holder.parent
                if holder.parent is not None:
                    at, open_links = holder.parent, 0
            continue
        if tag in SKIPPED:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, place)
            place = end.end() if end else size
            continue
        if tag in BLOCK:
            flush()
            if at.tag == "p" and tag != "p":
                at = at.parent
            elif at.tag == "p" or at.tag in CLOSES.get(tag, ()):
                at = at.parent
                if tag == "tr" and at.tag == "tr":
                    at = at.parent
            if tag not in VOID:
                at, open_links = _element(tag, found[3], at), 0
    flush()
    return out


def score(block: Block, has_good: bool) -> float:
    """Log-odds that a block is content."""
    element = block.element
    if element.bad:
        return -20.0
    links = block.linked / len(block.text)
    if element.good:
        return 6.0 - 4.0 * links
    words = block.text.count(" ") + 1
    own = -1.5 + 0.12 * min(words, 40) - 5.0 * links
    own += 1.0 if block.text[-1] in ".!?:;\"'…»”" else -0.5
    own += {"p": 1.5, "blockquote": 1.0, "pre": 1.0, "h1": 2.0, "h2": 1.0, "h3": 0.5, "li": -1.0, "td": -0.5}.get(element.tag, 0.0)
    # Where a page marks its content, the rest is seldom part of it.
    return own - 8.0 if has_good else own


def _near(a: Element, b: Element) -> int:
    """Steps from the two elements up to their closest common one."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


SCALE = 1000


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity): neighbours in page order, and each block with
    the last one before it under the same parent element."""
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        if k:
            edges[k - 1, k] = SCALE * 2 // (1 + _near(blocks[k - 1].element, block.element))
        # Blocks live in elements of their own; their parent is what they share.
        parent = id(block.element.parent or block.element)
        if parent in last:
            edges[last[parent], k] = edges.get((last[parent], k), 0) + SCALE // 2
        last[parent] = k
    return [(a, b, c) for (a, b), c in edges.items()]


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source when node k is tied to it with
    ``gain[k]`` (to the sink, if negative) and pairs are tied by ``edges``.

    Maximum flow by shortest augmenting paths over levels (Dinic); the source
    side is what the residual graph still reaches. Nodes between two equal cuts
    fall to the sink.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forward: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(forward)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for k, g in enumerate(gain):
        if g > 0:
            arc(source, k, g, 0)
        elif g < 0:
            arc(k, sink, -g, 0)
    for a, b, c in edges:
        arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for node in queue:
            for e in out[node]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[node] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                path, node = [], source
                continue
            while following[node] < len(out[node]):
                e = out[node][following[node]]
                if left[e] and level[to[e]] == level[node] + 1:
                    break
                following[node] += 1
            if following[node] < len(out[node]):
                path.append(e)
                node = to[e]
            elif path:
                node = to[path.pop() ^ 1]
                following[node] += 1
            else:
                break


def main_text(page: str) -> str:
    """Content blocks of a page, one a line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    has_good = any(b.element.good and not b.element.bad for b in blocks)
    odds = [score(b, has_good) for b in blocks]
    # Costs of the two labels; only their difference matters to the cut.
    gain = [round(SCALE * (math.log1p(math.exp(z)) - math.log1p(math.exp(-z)))) for z in odds]
    kept = minimum_cut(gain, smoothness(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row: the main text, blocks joined by
    newlines, and its code points.

    Character references are decoded and white space within a block becomes
    one space. Null or empty pages, and pages without content, give an empty
    text; broken markup is read as far as it goes, and pages are read whole.
    Null ids and urls pass through; repeated rows come out as often; an empty
    table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = bounded_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
