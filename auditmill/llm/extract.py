"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier gives each block log-odds of being content; these become the
capacities of its edges from the source and to the sink. They have two parts: what the markup says (the tags
and names of the elements around the block, with stated weights), and what the text says (length, share of
linked text, end mark, share of letters, kind of block), a logistic model that is fitted to the pages at hand.
Its labels are weak ones: blocks in an article or main without a contrary name are content, blocks in
navigation, footers, forms and the like are not; blocks that the markup says nothing of have none. What the
text says is bounded by TEXT_MOST, so that it decides where the markup is silent.

Blocks next to each other, and blocks with a near common ancestor, are joined by edges whose capacity is the
price of labelling them unlike; it is of the same size as TEXT_MOST, so that a block which reads like the other
kind follows its neighbours, and one that the markup names doesn't. The minimum cut, found by maximum flow, is
the cheapest labelling of the whole page.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page; their content is skipped up to the end tag.
RAW = frozenset("script style template noscript textarea title svg iframe object canvas audio video math".split())
#: Elements within a block; all others end it.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that opens closes these first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote dl div fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SPACE = re.compile(r"\s+")
#: Where the content of such an element ends; the page itself is searched, as lower() can change its length.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}

# What tags and class names say of the text below them, as log-odds of being content.
TAGS = {"article": 3.0, "main": 2.5, "nav": -9.0, "footer": -9.0, "aside": -8.0, "form": -9.0, "button": -9.0, "select": -9.0, "menu": -9.0, "dialog": -8.0, "header": -5.0, "fieldset": -6.0, "head": -12.0, "p": 0.5, "blockquote": 0.3, "pre": 0.5, "li": -0.3}
NAMES = [
    (re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|adsense|adslot|banner|sponsor(?:ed)?|promo(?:tion)?s?|outbrain|taboola)(?:[-_\s\d]|$)"), -9.0),
    (re.compile(r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|topbar|tabs)(?:[-_\s\d]|$)"), -8.0),
    (re.compile(r"(?:^|[-_\s])(?:footer|foot|colophon|copyright|legal|sidebar|side|aside|widget|related|recommend(?:ed|ations)?|popular|trending|more|masthead|siteheader)(?:[-_\s\d]|$)"), -8.0),
    (re.compile(r"(?:^|[-_\s])(?:comments?|respond|reply|replies|disqus|discussion)(?:[-_\s\d]|$)"), -9.0),
    (re.compile(r"(?:^|[-_\s])(?:cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|paywall|share|sharing|social|tags|hidden)(?:[-_\s\d]|$)"), -8.0),
    (re.compile(r"(?:^|[-_\s])(?:article|content|entry|post|story|body|main|text)(?:[-_\s\d]|$)"), 1.0),
]
#: Price of labelling two neighbours unlike, and of two blocks whose common ancestor is one element up (half of it for two).
NEXT, NEAR = 0.3, 1.5
#: Log-odds that a text's own features can give at most, either way.
TEXT_MOST = 2.5
#: Pages, and blocks of them, that the text's model is fitted to at most; blocks of either kind that it needs.
FIT_PAGES, FIT_BLOCKS, LEAST = 1000, 40_000, 50
#: The text's model where there is nothing to fit it to, and what a fitted one is drawn to: intercept, then the weights of `text_features`.
PRIOR = (-0.6, 0.35, -3.0, 0.7, 0.5, 0.4, -0.3)
RIDGE = 20.0
#: Elements that some sites wrap around everything; they say nothing where they hold MOST of the text or stand around the article.
WRAPPERS = frozenset(("form", "fieldset", "header"))
#: What keeps an element from being shown, and what it says of the text below.
HIDDEN, UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:;|!|$)"), -9.0
#: Names say little against an element that holds so much of the page's text, and nothing against one around an article or main with so much of it.
MOST, SHARE, LITTLE = 0.7, 0.2, -1.0


class Block:
    __slots__ = ("path", "parts", "linked")

    def __init__(self, path: tuple[tuple[int, str, float, float], ...]):
        self.path, self.parts, self.linked = path, [], 0

    def text(self) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


def _names(attributes: str) -> float:
    """What an element's class, id and role say of it, and whether it is shown at all; the strongest statement holds."""
    if "hidden" in attributes.lower() or "display" in attributes.lower():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            if name.lower() == "hidden" or name.lower() == "style" and HIDDEN.search((a or b or c).lower()):
                return UNSEEN
    found = " ".join((a or b or c).lower() for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role", "aria-label"))
    if not found:
        return 0.0
    return min((w for rx, w in NAMES if rx.search(found)), default=0.0)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, each with its open elements as (number, tag, log-odds of the tag, of its names)."""
    out: list[Block] = []
    stack: list[tuple[int, str, float, float]] = []
    now: Block | None = None
    at, number, links = 0, 0, 0

    def text(raw: str) -> None:
        nonlocal now
        if now is None:
            if not raw.strip():
                return
            now = Block(tuple(stack))
            out.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    def pop(tags) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][1] in tags:
                del stack[i:]
                return
            if stack[i][1] in ("table", "ul", "ol", "dl") and not tags & {"table", "ul", "ol", "dl", "div", "article", "main", "section", "body"}:
                return

    while m := TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        now, links = None, 0
        if m[1]:
            pop({tag})
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag in CLOSES:
            pop(CLOSES[tag])
        if tag in BLOCKS_END_P and stack and stack[-1][1] == "p":
            stack.pop()
        if tag not in VOID:
            number += 1
            # the header of an article is part of it
            own = tag == "header" and any(t in ("article", "main") for _, t, _, _ in stack)
            stack.append((number, tag, 0.0 if own else TAGS.get(tag, 0.0), _names(m[3])))
    if at < len(page):
        text(page[at:])
    return [b for b in out if b.text()]


def ease(found: list[Block], texts: list[str]) -> None:
    """Takes back what names and WRAPPERS say against elements that can't be boilerplate as a whole.

    Names of html and body speak of the layout. Those of an element that holds MOST of the page's text, or of one
    around an article or main that holds a SHARE of it, don't outweigh what is nearer to the text; nor does a form
    or header say anything there.
    """
    if not any(names < 0 or odds < 0 and tag in WRAPPERS for b in found for _, tag, odds, names in b.path):
        return
    held: dict[int, int] = {}
    for b, t in zip(found, texts):
        for number, *_ in b.path:
            held[number] = held.get(number, 0) + len(t)
    whole = sum(map(len, texts))
    for b in found:
        near, path = False, []
        for number, tag, odds, names in reversed(b.path):
            most = held[number] >= MOST * whole
            if names < 0:
                if near or tag in ("html", "body"):
                    names = 0.0
                elif most:
                    names = max(names, LITTLE)
            if odds < 0 and tag in WRAPPERS and (near or most):
                odds = 0.0
            path.append((number, tag, odds, names))
            near = near or (tag in ("article", "main") and held[number] >= SHARE * whole)
        b.path = tuple(reversed(path))


def text_features(block: Block, text: str) -> tuple[float, ...]:
    """Length, share of linked text, end mark, share of letters, whether it is a paragraph, whether it is an item of a list."""
    n = len(text)
    ends = text[-1] in ".!?:;\"'»”…。"
    tag = block.path[-1][1] if block.path else ""
    letters = sum(c.isalpha() for c in text) / n
    return math.log1p(n / 20), min(1.0, block.linked / n), float(ends), letters - 0.7, float(tag in ("p", "pre", "blockquote")), float(tag == "li")


def markup_odds(block: Block) -> float:
    """What the elements around a block say: the strongest statement of either kind."""
    path = [odds + names for _, _, odds, names in block.path]
    return max([0.0, *path]) + min([0.0, *path])


def log_odds(block: Block, text: str, model: tuple[float, ...] = PRIOR) -> float:
    """Log-odds that a block is content: the markup's, and the text's within its bound."""
    own = model[0] + sum(w * x for w, x in zip(model[1:], text_features(block, text)))
    return markup_odds(block) + max(-TEXT_MOST, min(TEXT_MOST, own))


def weak_label(block: Block) -> int | None:
    """1 in an article or main, 0 where a tag or name says boilerplate, None where the markup is silent or of two minds."""
    good = any(tag in ("article", "main") for _, tag, _, _ in block.path)
    bad = any(odds <= -5 or names <= -5 for _, _, odds, names in block.path)
    return None if good == bad else int(good)


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The text's model for features x and weak labels y: a logistic one, both kinds weighing the same, drawn to PRIOR. With too few of a kind it is PRIOR."""
    good = int(y.sum())
    if good < LEAST or len(y) - good < LEAST:
        return PRIOR
    x = np.column_stack([np.ones(len(x)), x])
    # both kinds together weigh as much as 1,000 blocks, however many there are
    weight = np.where(y == 1, 500.0 / good, 500.0 / (len(y) - good))
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - RIDGE * (w - prior))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(pages: DataFrame) -> tuple[float, ...]:
    """Fits the text's model to weak labels of at most FIT_PAGES pages, drawn by a hash of their html, and FIT_BLOCKS of their blocks."""
    names = [f"x{i}" for i in range(len(PRIOR) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(page)
                texts = [b.text() for b in found]
                ease(found, texts)
                rows += [(h, i, y, *text_features(b, t)) for i, (b, t) in enumerate(zip(found, texts)) if (y := weak_label(b)) is not None]
            cols = list(zip(*rows)) or [()] * (3 + len(names))
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["h", "i", "y", *names])

    text = F.col("html").cast("string")
    rows = pages.select(F.xxhash64(text).alias("h"), text.alias("html")).where("html <> ''")
    # hashes alone are sorted; pages travel only if they are drawn, and copies of a page as one
    edge = rows.select("h").distinct().orderBy("h").limit(FIT_PAGES).agg(F.max("h")).first()[0]
    if edge is None:
        return PRIOR
    drawn = rows.where(F.col("h") <= edge).groupBy("h").agg(F.min("html").alias("html"))
    rows = drawn.mapInArrow(run, ", ".join(["h long, i int, y int", *(f"{n} double" for n in names)]))
    got = rows.orderBy("h", "i").limit(FIT_BLOCKS).toArrow()  # a few numbers a block
    if not got.num_rows:
        return PRIOR
    return fitted(np.column_stack([got.column(n).to_numpy() for n in names]), got.column("y").to_numpy())


class Flow:
    """Maximum flow by shortest augmenting paths in level graphs."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                b = self.to[e]
                if self.room[e] > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Sends all the flow there is; then the nodes that s still reaches are the smallest cut's."""
        to, room, edges = self.to, self.room, self.edges
        while True:
            level = self.levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            turn = [0] * len(edges)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    path.clear()
                    a = s
                while turn[a] < len(edges[a]):
                    e = edges[a][turn[a]]
                    if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                        path.append(e)
                        a = to[e]
                        break
                    turn[a] += 1
                else:
                    if a == s:
                        break
                    a = to[path.pop() ^ 1]
                    turn[a] += 1


def label(found: list[Block], texts: list[str], model: tuple[float, ...] = PRIOR) -> list[bool]:
    """Which blocks are content: the source's side of the minimum cut."""
    n = len(found)
    ease(found, texts)
    flow = Flow(n + 2)
    for i, (b, t) in enumerate(zip(found, texts)):
        x = log_odds(b, t, model)
        # costs of the two labels: -log of their probabilities
        flow.join(n, i, math.log1p(math.exp(min(x, 30.0))) if x < 30 else x)
        flow.join(i, n + 1, math.log1p(math.exp(min(-x, 30.0))) if x > -30 else -x)
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        if i:
            flow.join(i - 1, i, NEXT, NEXT)
        for up in (1, 2):  # the element that the block's own stands in, and the one around that
            if len(b.path) > up and b.path[-1 - up][1] not in ("body", "html"):
                key = (up, b.path[-1 - up][0])
                if key in last:
                    flow.join(last[key], i, NEAR / up, NEAR / up)
                last[key] = i
    return flow.source_side(n, n + 1)[:n]


def main_text(page: str, model: tuple[float, ...] = PRIOR) -> str:
    """The page's content blocks, white space within a block made one space, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    texts = [b.text() for b in found]
    return " ".join(t for t, keep in zip(texts, label(found, texts, model)) if keep)


def _texts(model: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html; more columns are ignored).

    The text's model is fitted to the pages unless it is given. Null or empty html, or a page without content,
    gives an empty text; null ids and urls stay null; rows that repeat come through; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    model = model or fit(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_texts(model), "page_id long, url string, text string, n_chars long")
