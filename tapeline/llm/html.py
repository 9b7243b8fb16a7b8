"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. A logistic classifier, fitted on labelled pages, gives each block the cost
of either label (terminal capacities) from its length, links, punctuation, tag, place, neighbours and what its
ancestors' names say; neighbours in the page and blocks of one parent are joined by smoothness edges whose
weights are how much oftener such blocks of the labelled pages share a label than not; the minimum cut labels
the page.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .linear import Linear, fit
from .page_samples import labelled_pages

# Element names of HTML, and words that sites use in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SILENT = frozenset("script style head title noscript template svg math iframe object canvas audio video select datalist textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BOILER_TAGS = frozenset("nav header footer aside form menu button dialog".split())
BOILER_WORDS = frozenset(
    """nav navbar navigation menu footer header masthead sidebar side ad ads adv advert adverts advertisement advertising banner
    cookie cookies consent gdpr notice notices alert promo promotion share sharing social related recommended comment comments
    disqus reply replies discussion form newsletter subscribe signup login popup modal overlay breadcrumb breadcrumbs pagination
    pager toolbar widget widgets sponsor sponsored contentinfo complementary search skip copyright legal toc topbar tags""".split()
)
ARTICLE_WORDS = frozenset("article content post entry story body text main".split())
COMMENT_WORDS = frozenset("comment comments reply replies ad ads sponsored promo".split())
ROOTS = frozenset(("html", "body", "main"))
LISTS = frozenset("ul ol menu dl table nav".split())


#: Labelled pages on which the model is fitted, and of these the ones that choose the edges' weight.
PAGES, CHOOSING = 1500, 500
#: Steps through the DOM between two neighbouring blocks that are told apart; more count as the last.
APART = 8


class Block(NamedTuple):
    text: str
    tag: str
    parent: int
    links: int
    good: bool
    bad: bool
    apart: int
    depth: int
    listed: bool


class _Node(NamedTuple):
    tag: str
    number: int
    good: bool
    bad: bool
    hidden: bool
    listed: bool


class Blocks(HTMLParser):
    """Collects the text blocks of a page; unclosed and misnested tags are tolerated."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Node("", 0, False, False, False, False)]
        self.count, self.text, self.linked, self.in_link = 0, [], 0, 0
        self.low = self.before = 0  # least depth since the last block, and that block's
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                at = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag not in INLINE)
                up = next((k for k in range(at - 1, -1, -1) if self.stack[k].tag not in INLINE), at)
                home, low = self.stack[at], min(self.low, at, self.before)
                apart = self.before + at - 2 * low
                self.blocks.append(Block(text, home.tag, self.stack[up].number, min(self.linked, len(text)), home.good, home.bad, apart, at, home.listed))
                self.low = self.before = at
            self.text, self.linked = [], 0

    def close_to(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                self.low = min(self.low, k - 1)
                return
            if self.stack[k].tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr", "img", "wbr"):
            self.text.append(" ")
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_to(("p",), ("article", "section", "div", "td", "li", "body", "main", "aside", "footer", "header", "nav", "form", "blockquote"))
        if tag in SIBLING:
            self.close_to(SIBLING[tag], SCOPE[tag])
        up, seen = self.stack[-1], dict(attrs)
        said = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(seen.get(k) or "" for k in ("class", "id", "role"))).lower()))
        hidden = up.hidden or tag in SILENT or "hidden" in seen or seen.get("aria-hidden") == "true" or "display:none" in (seen.get("style") or "").replace(" ", "")
        good = up.good or tag in ("article", "main") or (tag not in INLINE and bool(said & ARTICLE_WORDS) and not said & BOILER_WORDS)
        title = tag == "header" and up.good
        bad = up.bad or (tag in BOILER_TAGS and not title) or (tag not in ROOTS and not title and bool(said & (COMMENT_WORDS if tag == "article" else BOILER_WORDS)))
        self.count += 1
        self.stack.append(_Node(tag, self.count, good, bad, hidden, up.listed or tag in LISTS))
        self.in_link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                self.low = min(self.low, k - 1)
                return
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].hidden:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def blocks_of(page: str) -> list[Block]:
    p = Blocks()
    p.feed(page)
    p.close()
    p.flush()
    return p.blocks


_HEADING = re.compile(r"h[1-6]")
_STOP = re.compile(r"[.!?…。！？][)\"'»”]?(?=\W|$)")


def features(blocks: list[Block]) -> np.ndarray:
    """One row for each block of a page; every column lies between -1 and about 2."""
    n = len(blocks)
    chars = np.array([len(b.text) for b in blocks], float)
    words = np.array([b.text.count(" ") + 1 for b in blocks], float)
    linked = np.array([b.links for b in blocks], float) / chars
    stops = np.array([len(_STOP.findall(b.text)) for b in blocks], float)
    tags = [b.tag for b in blocks]
    head = np.array([bool(_HEADING.fullmatch(t)) for t in tags], float)
    size = np.minimum(np.log(words), 5.0) / 2.5
    _, kin = np.unique([b.parent for b in blocks], return_inverse=True)
    rest = np.bincount(kin, words)[kin]
    pad = np.concatenate([[0.0], size * (1 - linked), [0.0]])
    place = np.arange(n) / max(n - 1, 1)
    good, bad = np.array([b.good for b in blocks], float), np.array([b.bad for b in blocks], float)
    return np.stack(
        [
            size,
            size * size,
            linked,
            linked > 0.5,
            stops > 0,
            np.minimum(stops / words, 0.5),
            [t in ("p", "pre", "blockquote") for t in tags],
            head,
            [t in ("li", "td", "th", "dd", "dt") for t in tags],
            [b.listed for b in blocks],
            ["©" in b.text[:3] for b in blocks],
            np.minimum(np.log(rest), 7.0) / 3.5,
            np.bincount(kin, linked * words)[kin] / rest,
            pad[:-2],
            pad[2:],
            place < 0.1,
            place > 0.9,
            np.cumsum(head) > 0,
            [min(b.depth, 12) / 6 for b in blocks],
            good,
            bad,
            good * bad,
        ],
        axis=1,
    ).astype(float)


class Model(NamedTuple):
    """Costs of labels, and the weights of edges: by steps through the DOM, and between blocks of one parent."""

    block: Linear
    near: np.ndarray
    kin: float

    def without_edges(self) -> Model:
        return self._replace(near=self.near * 0, kin=0.0)


def _pairs(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, kind): neighbours by their distance in the DOM, then (kind -1) the next of the same parent and tag."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, min(b.apart, APART)))
        before = last.get((b.parent, b.tag))
        if before is not None and before < i - 1:
            out.append((before, i, -1))
        last[(b.parent, b.tag)] = i
    return out


def train(pages: Iterable[tuple[str, set[str]]], choosing: int, strengths: tuple[float, ...] = (0.0, 0.15, 0.3, 0.5, 0.75, 1.0, 1.5)) -> Model:
    """Fitted on (html, texts of its content blocks); the last ``choosing`` pages choose the edges' strength.

    An edge's weight is that strength times the log odds that blocks so placed share a label.
    """
    parsed = [(blocks, np.array([b.text in truth for b in blocks])) for blocks, truth in ((blocks_of(h), t) for h, t in pages) if blocks]
    part = max(len(parsed) - choosing, 1)
    x, y = np.vstack([features(b) for b, _ in parsed[:part]]), np.concatenate([t for _, t in parsed[:part]]).astype(float)
    block = fit(x, y, l2=0.5, steps=25)
    same, differ = np.ones(APART + 2), np.ones(APART + 2)  # the last place is that of kind -1
    for blocks, truth in parsed[:part]:
        for i, j, kind in _pairs(blocks):
            (same if truth[i] == truth[j] else differ)[kind] += 1
    odds = np.maximum(np.log(same / differ), 0)
    best = (-1, None)
    for s in strengths:
        m = Model(block, odds[:-1] * s, float(odds[-1] * s))
        right = sum(int((np.array(label(blocks, m)) == truth).sum()) for blocks, truth in parsed[part:])
        if right > best[0]:
            best = (right, m)
    return best[1]


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Fitted on PAGES pages of page_samples, the same in every process."""
    return train(labelled_pages(PAGES), CHOOSING)


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (Dinic's maximum flow).

    source[i] and sink[i] are terminal capacities; an edge (i, j, c) costs c if it is cut either way.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(i: int, j: int, c: float, back: float) -> None:
        out[i].append(len(to))
        to.append(j)
        cap.append(c)
        out[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i in range(n):
        direct = min(source[i], sink[i])  # flows straight through
        if source[i] > direct:
            add(s, i, source[i] - direct, 0.0)
        if sink[i] > direct:
            add(i, t, sink[i] - direct, 0.0)
    for i, j, c in edges:
        add(i, j, c, c)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
                continue
            path.append(e)
            u = to[e]


def label(blocks: list[Block], model: Model) -> list[bool]:
    """Content or not, for each block: the labelling of least cost."""
    if not blocks:
        return []
    z = np.clip(model.block.score(features(blocks)), -30, 30)
    edges = [(i, j, float(model.kin if kind < 0 else model.near[kind])) for i, j, kind in _pairs(blocks)]
    return minimum_cut(np.log1p(np.exp(z)).tolist(), np.log1p(np.exp(-z)).tolist(), [e for e in edges if e[2] > 0])


def main_text(page: str | None, model: Model | None = None) -> tuple[str, int, int]:
    """The content blocks joined by newlines, the number of blocks, and how many are content."""
    blocks = blocks_of(page or "")
    keep = [b.text for b, k in zip(blocks, label(blocks, model or default_model()), strict=True) if k]
    return "\n".join(keep), len(blocks), len(keep)


def _extract(batches: Iterator[pa.RecordBatch], at: int, model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [main_text(x.as_py(), model) for x in b.column(at)]
        new = [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[k] for f in found], pa.int32()) for k in (1, 2))]
        names = [*b.schema.names, "_text", "_blocks", "_kept"]
        yield pa.RecordBatch.from_arrays([*b.columns, *new], names)


def extract_main_text(pages: DataFrame, *, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """pages without html_col, with text string, n_blocks int and n_kept int.

    White space inside a block (br included) becomes one space, blocks are trimmed, empty ones dropped, the
    rest joined by one newline in page order. Null or empty html: empty text, no blocks. Other columns pass
    through; one of these names is replaced. Repeated rows give repeated rows; no rows in, no rows out. A
    page is one row of one task whatever its length. model: see train(); by default one fitted on the driver
    on PAGES made pages (page_samples), whatever the table holds.
    """
    prepare(pages.sparkSession)
    fitted = model or default_model()
    at = pages.columns.index(html_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), "_text string, _blocks int, _kept int"])

    def extract(batches):
        return _extract(batches, at, fitted)

    out = pages.mapInArrow(extract, schema)
    names = {"text": "_text", "n_blocks": "_blocks", "n_kept": "_kept"}
    return out.select(*(c for c in pages.columns if c != html_col and c not in names), *(F.col(v).alias(k) for k, v in names.items()))
