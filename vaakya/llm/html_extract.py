"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text in page order. A logistic classifier gives each
block its costs for content and boilerplate, which are the capacities to the
two terminals; blocks that follow each other and blocks that share a parent
are joined by smoothness edges, stronger the nearer they stand in the tree.
The minimum cut separates content from boilerplate. ``WEIGHTS`` and ``EDGES``
were fitted by ``fit`` and by trial of a grid on the labelled pages that
``tests/llm/made_pages.py`` makes; names of classes are features among others.

Edge cases: null and empty pages give an empty text; unclosed, crossed and cut
off markup is read as far as it goes; a quote opens a value only where a value
begins and is closed; text outside any markup is a block; a script without an
end hides what follows it; rows that repeat a page_id are pages of their own;
other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table

#: Text, a comment, other declarations, or a tag: (end, name, attributes).
_TOKEN = re.compile(
    r"[^<]+|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</[^a-zA-Z][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?|=)*+)>?|<",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: A start tag of the first group ends an open tag of the second.
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HIDDEN = frozenset("head script style noscript template iframe svg math object canvas audio video select option datalist textarea button input title".split())
_BOIL = frozenset("nav footer aside form dialog menu header".split())
_BODY = frozenset("article main".split())
#: Words of class names, ids and roles that go with boilerplate.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist discussion disqus replies reply respond responses share sharing social related recommended recommendations "
    "widget widgets legal copyright disclaimer pagination pager search skip hidden tracking complementary contentinfo".split()
)
#: Words that say nothing beside a hint.
_PLAIN = frozenset("list item box block section wrapper wrap container inner outer bar area top bottom left right main site page global row col buttons links icons form text title body and by the slot unit zone".split())
_GOOD = frozenset("article content main post story entry body articlebody maincontent".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])", re.ASCII)
_RIGHTS = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("bias", "body", "outside", "frame", "hint", "part", "wide", "good", "para", "head", "item", "long", "short", "links", "stop", "rights")
#: Fitted: log-odds of content for each feature.
WEIGHTS = (0.92, 1.96, -3.7, -6.5, -11.38, -2.72, 1.04, 1.06, 0.8, 1.15, 2.55, 1.68, 0.73, -8.01, -0.78, -4.28)
#: Fitted: what an edge between neighbours in the page, and one between blocks of a parent, is worth.
EDGES = (2.0, 0.5)


class Block:
    """A run of text between breaks, with what the classifier looks at."""

    __slots__ = ("text", "linked", "path", "body", "frame", "good", "tag", "hints")

    def __init__(self, text: str, linked: int, path: tuple[int, ...], body: bool, frame: bool, good: bool, tag: str, hints: tuple[int, ...]):
        self.text, self.linked, self.path, self.body, self.frame, self.good, self.tag, self.hints = text, linked, path, body, frame, good, tag, hints


def _named(attrs: str) -> tuple[int, bool, bool]:
    """(hint, content, hidden) by class, id, role and style; a hint is 2 if it is the whole of a name, 1 if a part."""
    hint, good, hidden = 0, False, False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            for part in value.split():
                words = [w.lower() for w in _SPLIT.split(part) if w]
                known = [w in _HINTS for w in words]
                if any(known):
                    rest = [w for w, k in zip(words, known, strict=True) if not k and w not in _PLAIN and not w.isdigit()]
                    hint = max(hint, 1 if rest else 2)
                elif any(w in _GOOD for w in words):
                    good = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDES.search(value):
            hidden = True
    return hint, good, hidden


class _Open:
    """An open element: what its descendants inherit."""

    __slots__ = ("name", "number", "frame", "body", "good", "hidden", "inline", "hints", "path", "linked")

    def __init__(self, name, number, frame, body, good, hidden, inline, hints, path, linked):
        self.name, self.number, self.frame, self.body, self.good, self.hidden, self.inline, self.hints, self.path, self.linked = name, number, frame, body, good, hidden, inline, hints, path, linked


class Page:
    """The blocks of a page in order, and the elements whose names are hints."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        #: number -> [whole name, holds the heading or main part]
        self.hinted: dict[int, list] = {}
        self._read(page)

    def _read(self, page: str) -> None:
        stack = [_Open("", 0, False, False, False, False, False, (), (0,), False)]
        text: list[str] = []
        linked, number, at, end = 0, 0, 0, len(page)

        def flush() -> None:
            nonlocal linked
            words = " ".join("".join(text).split())
            if words:
                top, own = stack[-1], next(x for x in reversed(stack) if not x.inline)
                self.blocks.append(Block(words, min(linked, len(words)), own.path, top.body, top.frame, top.good, own.name, top.hints))
            text.clear()
            linked = 0

        while at < end:
            m = _TOKEN.match(page, at)
            at = m.end()
            name = m.group(2)
            if name is None:
                t = m.group()
                if (t[0] != "<" or len(t) == 1) and not stack[-1].hidden:
                    t = _html.unescape(t) if "&" in t else t
                    text.append(t)
                    if stack[-1].linked:
                        linked += len(t)
                continue
            name, attrs = name.lower(), m.group(3)
            inline = name in _INLINE
            if not inline:
                flush()
            if m.group(1):
                i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
                if i and not (inline and any(not x.inline for x in stack[i + 1 :])):
                    del stack[i:]
                continue
            if name in _VOID:
                continue
            if name in _RAW:
                # Nothing but its own end tag ends it.
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else end
                if close:
                    at = (_TOKEN.match(page, at)).end()
                continue
            ends = {"p"} if name in _CLOSES_P else set()
            ends |= _SAME.get(name, set())
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in ends:
                        del stack[i:]
                        break
                    if not stack[i].inline and not (name in _SAME and stack[i].name == "p"):
                        break
            if attrs.rstrip().endswith("/") and name in ("svg", "math"):
                continue
            number += 1
            hint, good, hidden = _named(attrs) if "=" in attrs or "hidden" in attrs else (0, False, False)
            up = stack[-1]
            if name in ("html", "body"):
                hint = 0
            if name in ("h1", "main"):
                for k in up.hints:
                    self.hinted[k][1] = True
            hints = up.hints
            if hint and not inline:
                self.hinted[number] = [hint == 2, False]
                hints = (*hints, number)
            frame = up.frame or name in _BOIL and not (name == "header" and up.body)
            stack.append(_Open(name, number, frame, up.body or name in _BODY, up.good or good, up.hidden or hidden or name in _HIDDEN, inline, hints, up.path if inline else (*up.path, number), up.linked or name == "a"))
        flush()

    def features(self) -> np.ndarray:
        """A row of FEATURES for each block."""
        blocks = self.blocks
        every = sum(len(b.text) for b in blocks) or 1
        inside: dict[int, int] = {}
        for b in blocks:
            for k in b.hints:
                inside[k] = inside.get(k, 0) + len(b.text)
        # An element that holds the heading, or nearly all text, is a wrapper, whatever its name.
        wide = {k for k, (_, holds) in self.hinted.items() if holds or inside.get(k, 0) > 0.9 * every}
        kinds = [{("wide" if k in wide else "hint" if self.hinted[k][0] else "part") for k in b.hints} for b in blocks]
        any_body = any(b.body and not b.frame and not k & {"hint", "part"} and len(b.text) > 40 for b, k in zip(blocks, kinds, strict=True))
        rows = []
        for b, kind in zip(blocks, kinds, strict=True):
            n, head = len(b.text), len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
            rows.append(
                (
                    1.0, b.body, any_body and not b.body, b.frame, "hint" in kind, "part" in kind, "wide" in kind, b.good, b.tag in ("p", "blockquote", "pre"), head, b.tag in ("li", "td", "th", "dt", "dd"),
                    min(n, 300) / 100, n < 25, b.linked / n, b.text[-1] in ".!?…»”\"':;", not b.body and bool(_RIGHTS.search(b.text)),
                )
            )
        return np.array(rows, float).reshape(len(rows), len(FEATURES))

    def edges(self, near: float, parent: float) -> list[tuple[int, int, float]]:
        """Smoothness edges: neighbours in the page, by their distance in the tree, and blocks of one parent."""
        out, last = [], {}
        for i, b in enumerate(self.blocks):
            if i:
                a = self.blocks[i - 1].path
                same = next((k for k, (x, y) in enumerate(zip(a, b.path, strict=False)) if x != y), min(len(a), len(b.path)))
                out.append((i - 1, i, near / (1 + len(a) + len(b.path) - 2 * same)))
            up = b.path[:-1]
            if up in last:
                out.append((last[up], i, parent))
            last[up] = i
        return out


def fit(pages: list[tuple[np.ndarray, np.ndarray]], ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Logistic weights from (features, is content) of labelled pages, by Newton's method with a ridge."""
    x = np.concatenate([f for f, _ in pages])
    y = np.concatenate([c for _, c in pages]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (Dinic's algorithm)."""
    n = len(source)
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(u: int, v: int, forth: float, back: float) -> None:
        graph[u].append(len(to))
        to.append(v)
        cap.append(forth)
        graph[v].append(len(to))
        to.append(u)
        cap.append(back)

    s, t = n, n + 1
    for i in range(n):
        # What both terminals would carry flows at once.
        if source[i] > sink[i]:
            join(s, i, source[i] - sink[i], 0.0)
        elif sink[i] > source[i]:
            join(i, t, sink[i] - source[i], 0.0)
    for u, v, w in edges:
        join(u, v, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(graph[u]):
                e = graph[u][at[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(graph[u]):
                path.append(graph[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def labels(page: Page, weights: tuple[float, ...] = WEIGHTS, edges: tuple[float, float] = EDGES) -> list[bool]:
    """Which blocks of a page are content."""
    odds = (page.features() @ np.asarray(weights)).tolist()
    return cut([max(o, 0.0) for o in odds], [max(-o, 0.0) for o in odds], page.edges(*edges))


def main_text(page: str | None) -> str:
    """The main text of a page."""
    found = Page(page or "")
    if not found.blocks:
        return ""
    return " ".join(b.text for b, k in zip(found.blocks, labels(found), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of (page_id, url, html)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the table."""
    arrow_rows(spark, 500)
    return extract(table(spark, sf_dir, "pages"))
