"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a graph of text blocks and of the containers around them. A classifier over a
block's own text (length, end, links, element) and over a container's element and names gives
each node a cost for either label; the costs are capacities to the two terminals. Smoothness
edges join neighbouring blocks, the weaker the further apart they are in the DOM, blocks of one
parent, and each block with the containers that say something about it. The minimum cut
separates content from boilerplate.

A block's own cost is of the order of its edges, so most short lines of an article, and
sentences of a sidebar, get their label through the cut. What a container says is certain (its
capacity exceeds all its edges) by its element, or by a name that says nothing else (`sidebar`,
`site-footer`), or doubtful: a form, an article of an unlikely name, a name of several words of which
one is boilerplate's (`legal-news`). A doubtful one gives way when the texts in it weigh more. A name says
nothing where it tells what a container has, or of another name that is content's. One of
content by its name alone holds its blocks by weaker edges, so that lists of links in it may leave.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A tag's attributes. Quoted values may hold any sign; where a quote stays open the tag ends at its first '>'.
_ATTRIBUTES = r"""(?:(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*+>)"""
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<(script|style|noscript|textarea|title|iframe)(?=[\s/>]){_ATTRIBUTES}(?:.*?</\1\s*>|.*)"
    rf"|<(/?)([a-zA-Z][^\s<>/]*)({_ATTRIBUTES})|<[!?][^<>]*>",
    re.DOTALL | re.IGNORECASE,
)
_PAIRS = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements that end a block of text where they start and end.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: What an opening tag closes if it is open in the same container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is not the page's. Unlike those of raw text they hold elements.
SKIPPED = frozenset("template svg canvas object select button video audio".split())
#: Elements that hold boilerplate for certain or perhaps, elements of content, and words in class, id, role and label.
BAD_TAGS = frozenset("nav footer aside menu dialog search header head".split())
DOUBTFUL_TAGS = frozenset(["form"])
GOOD_TAGS = frozenset("article main".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond responses discussion widget pagination pager search form tagcloud "
    "skip toolbar copyright legal disclaimer paywall toast complementary contentinfo hidden outbrain taboola feedback rating".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
GOOD_NAMES = frozenset("article content entry post story main articlebody".split())
#: Words of a name that tell its place or shape, and words that make it tell of a state or a part of the container.
SHAPE_NAMES = frozenset(
    "site page global top bottom left right upper lower inner outer wrap wrapper container holder box block section area region zone row col column list item items link links "
    "bar slot panel button buttons icon icons posts articles stories body group unit module primary secondary tertiary main js widget".split()
)
STATE_NAMES = frozenset("has is with no not without enabled disabled open closed show shown active supports can allow".split())
TAG_HINT = {"p": 0.4, "li": 0.4, "blockquote": 0.4, "pre": 0.4, "h1": 0.8, "h2": 0.8, "h3": 0.8}
#: Capacities of edges: between neighbours, in one parent, to a container, and to one of content by its name alone.
ADJACENT, SAME_PARENT, HELD, LEANING = 1.0, 0.5, 5.0, 1.5
#: Capacity of a doubtful container to its terminal.
DOUBTFUL = 9.0
#: What a container says: content for certain or by its name, boilerplate for certain or doubtful.
CONTENT, NAMED_CONTENT, BOILERPLATE, DOUBTED = "content", "named content", "boilerplate", "doubted"


#: Of an article or main part: by its name it is boilerplate.
UNLIKELY = "unlikely"


def _words_of(name: str) -> set[str]:
    return {part.lower() for part in _PARTS.findall(name)}


def said_by(name: str) -> tuple[str | None, bool]:
    """What one name says: BOILERPLATE, DOUBTED or nothing, and whether it is of content."""
    words = _words_of(name)
    if words & STATE_NAMES:
        return None, False
    if words == {"hidden"}:
        return (BOILERPLATE if name.lower() == "hidden" else None), False
    bad, good = words & BAD_NAMES - {"hidden"}, words & GOOD_NAMES
    if not bad:
        return None, bool(good)
    if words <= BAD_NAMES | SHAPE_NAMES or bad & COMMENT_NAMES and words <= BAD_NAMES | SHAPE_NAMES | GOOD_NAMES:
        return BOILERPLATE, False
    return DOUBTED, False


@dataclass
class Block:
    text: str
    score: float  # of the text itself; over 0: content
    depth: int  # of open elements
    shared: int  # of those, how many were open from the block before on
    parent: int  # the container of its own element
    held: tuple[int, ...]  # containers around it that say something about it


@dataclass
class Element:
    tag: str
    number: int
    bad: int = 0  # the container of boilerplate that it is or lies in; 0: none
    certain: bool = False  # whether that one is certain
    good: int = 0  # the container of content that it is or lies in


def _closed(tokens: list[re.Match]) -> set[int]:
    """Where skipped elements start that have an end tag of their own; of others nothing is skipped."""
    closed: set[int] = set()
    starts: dict[str, list[int]] = {}
    for m in tokens:
        tag = (m[3] or "").lower()
        if tag in SKIPPED:
            own = starts.setdefault(tag, [])
            if not m[2]:
                if not m[4].endswith("/>"):
                    own.append(m.start())
            elif own:
                closed.add(own.pop())
    return closed


class _Page:
    """One pass over the tags: the stack of open elements, and the blocks so far."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.says: dict[int, str] = {}  # of the containers
        self.stack: list[Element] = []
        self.low = 0
        self.pieces: list[str] = []
        self.link = self.linked = self.seen = 0
        self.inside: list[str] = []  # elements open in a skipped one, itself first
        at = 0
        tokens = list(_TOKEN.finditer(html))
        closed = _closed(tokens)
        for m in tokens:
            if m.start() > at and not self.inside:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag:
                tag = tag.lower()
                if self.inside:
                    self._skip(tag, m, closed)
                elif m[2]:
                    self._close(tag)
                elif tag in SKIPPED:
                    if m.start() in closed:
                        self.inside.append(tag)
                else:
                    self._open(tag, m[4])
        self._text(html[at:])
        self._flush()

    def _skip(self, tag: str, m: re.Match, closed: set[int]) -> None:
        """A tag inside a skipped element, which ends with its own end tag or with that of an element around it."""
        if not m[2]:
            if tag not in VOID and not m[4].endswith("/>") and (tag not in SKIPPED or m.start() in closed):
                self.inside.append(tag)
        elif tag in self.inside:
            while self.inside.pop() != tag:
                pass
        elif tag == "a" or any(element.tag == tag for element in self.stack):
            if tag != "a":
                self.inside.clear()
            self._close(tag)

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.link:
            self.linked += len(text)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                depth = len(self.stack)
                top = self.stack[-1] if self.stack else Element("", 0)
                held = (top.bad,) if top.certain else tuple(n for n in (top.bad, top.good) if n)
                self.blocks.append(Block(text, self._score(text, top.tag), depth, min(self.low, depth), self.stack[-2].number if depth > 1 else 0, held))
                self.low = depth
        self.pieces, self.linked = [], 0

    def _score(self, text: str, tag: str) -> float:
        score = min(len(text), 150) / 50 - 1 + 0.5 * text.endswith((".", "!", "?", "…", '"', "»")) + TAG_HINT.get(tag, 0.0) + 1.5 * (not self.stack)
        density = min(1.0, self.linked / len(text))
        return score - 3.0 * (density > 0.6) * density

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag == "a":
            self.link = 1
        bad, good = self._named(attributes, tag) if attributes and tag not in ("html", "body") else (None, False)
        if tag in BLOCK or bad:
            self._flush()
            if tag in CLOSES:
                self._imply(CLOSES[tag], _SCOPES.get(tag, set()))
            elif tag in BLOCK:
                self._imply({"p"}, set())
            if tag not in VOID and not attributes.endswith("/>"):
                self._push(tag, bad, good)

    def _push(self, tag: str, bad: str | None, good: bool) -> None:
        self.seen += 1
        around = self.stack[-1] if self.stack else Element("", 0)
        new = Element(tag, self.seen, around.bad, around.certain, around.good)
        in_good = around.good and self.says[around.good] == CONTENT
        if not around.certain:
            if bad == BOILERPLATE or tag in BAD_TAGS and not (tag == "header" and in_good):
                new.bad, new.certain, self.says[self.seen] = self.seen, True, BOILERPLATE
            elif not around.bad and (bad or tag in DOUBTFUL_TAGS):
                new.bad, self.says[self.seen] = self.seen, DOUBTED
            elif tag in GOOD_TAGS:
                new.good, self.says[self.seen] = self.seen, CONTENT
            elif good and not around.good:
                new.good, self.says[self.seen] = self.seen, NAMED_CONTENT
        self.stack.append(new)

    def _named(self, attributes: str, tag: str) -> tuple[str | None, bool]:
        """What an opening tag's names and visibility say: BOILERPLATE, DOUBTED or nothing, and whether one is of content."""
        found, good = set(), False
        for m in _PAIRS.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true":
                found.add(BOILERPLATE)
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    found.add(BOILERPLATE)
            elif name in ("class", "id", "role", "aria-label"):
                for token in [value] if name == "aria-label" else value.split():  # a label is one name
                    bad, content = said_by(token)
                    good |= content
                    if bad == BOILERPLATE and tag in GOOD_TAGS and not _words_of(token) & COMMENT_NAMES:
                        bad = UNLIKELY
                    found.add(bad)
        if BOILERPLATE in found:
            return BOILERPLATE, good
        if UNLIKELY in found:
            return DOUBTED, good
        return DOUBTED if DOUBTED in found and not good and tag not in GOOD_TAGS else None, good

    def _imply(self, closed: set[str], scope: set[str]) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at].tag
            if tag in closed:
                self._drop(at)
                return
            if tag in scope or not scope and tag in ("div", "article", "section", "main", "aside", "td", "li", "blockquote", "form", "nav", "header", "footer", "body"):
                return

    def _drop(self, at: int) -> None:
        del self.stack[at:]
        self.low = min(self.low, at)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self._flush()
                self._drop(at)
                return
        if tag in BLOCK:
            self._flush()


def graph_of(html: str) -> tuple[list[Block], list[float], list[tuple[int, int, float]]]:
    """Blocks; costs of the blocks and, after them, of the containers that hold some; edges between these nodes."""
    page = _Page(html)
    edges = edges_of(page.blocks)
    scores = [b.score for b in page.blocks]
    n_held = Counter(n for b in page.blocks for n in b.held)
    place = {n: len(scores) + i for i, n in enumerate(n_held)}
    for n, blocks in n_held.items():
        certain = HELD * blocks + 1  # more than all edges of the container
        scores.append({CONTENT: certain, NAMED_CONTENT: certain, BOILERPLATE: -certain, DOUBTED: -DOUBTFUL}[page.says[n]])
    held = [(i, place[n], LEANING if page.says[n] == NAMED_CONTENT else HELD) for i, b in enumerate(page.blocks) for n in b.held]
    return page.blocks, scores, edges + held


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between each block and the one before it in its parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + blocks[i - 1].depth + block.depth - 2 * block.shared)))
        if last.get(block.parent, i) < i - 1:
            edges.append((last[block.parent], i, SAME_PARENT))
        last[block.parent] = i
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of the least cut, by Dinic's maximum flow.

    A node of positive score is tied to the source by it, one of negative score to the sink.
    """
    if all(s > 0 for s in scores) or all(s <= 0 for s in scores):
        return [s > 0 for s in scores]
    n = len(scores)
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, capacity in edges:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        room += (capacity, capacity)
    source, sink = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    eps = 1e-9
    while True:
        level = [0 if source[i] > eps else -1 for i in range(n)]
        queue = [i for i in range(n) if not level[i]]
        for i in queue:
            for arc in arcs[i]:
                if room[arc] > eps and level[to[arc]] < 0:
                    level[to[arc]] = level[i] + 1
                    queue.append(to[arc])
        if not any(sink[i] > eps for i in queue):
            return [at >= 0 for at in level]
        tried = [0] * n
        for start in range(n):
            while source[start] > eps:
                path, here = [], start
                while sink[here] <= eps:
                    while tried[here] < len(arcs[here]):
                        arc = arcs[here][tried[here]]
                        if room[arc] > eps and level[to[arc]] == level[here] + 1:
                            break
                        tried[here] += 1
                    if tried[here] < len(arcs[here]):
                        path.append(arc)
                        here = to[arc]
                    elif path:
                        here = to[path.pop() ^ 1]
                        tried[here] += 1
                    else:
                        break
                if sink[here] <= eps:
                    break
                flow = min([source[start], sink[here], *(room[arc] for arc in path)])
                source[start] -= flow
                sink[here] -= flow
                for arc in path:
                    room[arc] -= flow
                    room[arc ^ 1] += flow


def main_text(html: str | None) -> str:
    """The content blocks in page order, one a line; empty if there are none."""
    if not html:
        return ""
    blocks, scores, edges = graph_of(html)
    content = min_cut(scores, edges)
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=False) if keep)


def extracted(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns of pages (or those in keep) plus text and n_chars, its code points.

    A null or empty html gives an empty text. Broken markup is read as far as it goes: what is
    no tag is text. Repeated rows are each extracted. Columns text and n_chars are replaced.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("_loomspark_html")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    source = pages.select(pages[html_col].alias("_loomspark_html"), *[pages[c] for c in kept])
    return source.mapInArrow(extract, pages.select(*[pages[c] for c in kept]).schema.add("text", T.StringType()).add("n_chars", T.LongType()))
