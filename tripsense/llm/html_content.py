"""Main-text extraction by minimum cut over a page's text blocks.

A page is cut into blocks (the text between block-level tags). A classifier gives every
block the cost of being content or boilerplate; the costs are the capacities of its edges
to the two terminals. Neighbouring blocks are joined by smoothness edges (adjacency in the
page, and DOM proximity: children of the same parent are held together more than blocks
whose common ancestor is far up). The minimum cut, found by augmenting paths, labels all
blocks of a page at once.

The classifier has two parts: the landmarks of a block's ancestors (``nav``, ``footer``,
``article`` ..., roles, class and id words; a fixed prior; what text and neighbours say can overrule words), and a logistic
regression on
what the text itself shows (length, link density, punctuation, place), trained on the
blocks with clear landmarks of about ``fit_pages`` pages (twice as many at most; those whose hash
of the html is smallest). The sample only fits these few weights; every page is labelled whole.

One landmark of a page is its main one: of the ``article`` and ``main`` elements that lie in no other one, that
with the most text. It alone ends the class and id words of what it lies in (page layouts have names like
``content-sidebar-wrap``). Nested ones mark reader comments and teasers as often as articles, so they end nothing; below
a vague word they, and all other landmarks, count as what the word says.

Defined results: NULL or empty html gives an empty text; unclosed, stray and cut-off tags
are accepted; a page without landmarks is judged by the text features alone; an empty table gives an
empty result; repeated rows repeat their result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pages of the sample that fits the text classifier (about so many, twice as many at most)
FIT_PAGES = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[^>]*))(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: fixed values of HTML: elements whose content is no text of the page
_DROPPED = frozenset("script style noscript template svg iframe object canvas audio video head title "
                     "select textarea button datalist option input annotation annotation-xml".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
                   "nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an opening tag closes these when they are the innermost block
_CLOSES = {t: frozenset(("p",)) for t in _BLOCK} | {
    "li": frozenset(("p", "li")), "dt": frozenset(("p", "dt", "dd")), "dd": frozenset(("p", "dt", "dd")),
    "tr": frozenset(("p", "td", "th", "tr")), "td": frozenset(("p", "td", "th")), "th": frozenset(("p", "td", "th"))}

#: landmarks: log odds that a block under such an element is content
_TAG_ODDS = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "header": -6.0,
             "article": 5.0, "main": 4.0, "figcaption": -0.5, "fieldset": -6.0}
_ROLE_ODDS = {"navigation": -8.0, "banner": -6.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0,
              "dialog": -8.0, "alert": -8.0, "alertdialog": -8.0, "menu": -8.0, "menubar": -8.0, "main": 4.0, "article": 5.0}
#: odds of article and main, as tag or role, are this at least
_LANDMARK = 4.0
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager sidebar widget widgets rail aside footer foot masthead topbar "
    "toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommend recommended "
    "recommendations trending popular tags copyright legal disclaimer hidden paywall toc".split())
#: of these a name of several words may be a page's layout or subject (content-sidebar-wrap, legal-news)
_VAGUE_WORDS = frozenset(
    "sidebar widget widgets rail aside footer foot nav menu banner promo promotion toolbar notice notices alert overlay hidden toc "
    "subscribe subscription respond reply replies discussion share sharing social related recommend recommended recommendations "
    "trending popular tags copyright legal disclaimer login signup sponsor sponsored".split())
#: words that mark reader comments
_COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: first words of names of a page's state (has-sidebar)
_STATE_WORDS = frozenset("has no with without".split())
#: log odds of a class or id word; of a vague one in a name of several words outside and inside of article or main
_WORD_ODDS, _VAGUE_ODDS, _VAGUE_INSIDE = -5.0, -1.5, 1.0
_GOOD_WORDS = frozenset("article content main post entry story body text".split())
_LINK, _SAME_PARENT, _FAR = 0.5, 1.0, 4.0


class Block:
    __slots__ = ("text", "links", "path", "odds", "marked", "heading", "under")

    def __init__(self, text, links, path, heading, under):
        self.text, self.links, self.path, self.heading, self.under = text, links, path, heading, under
        self.odds, self.marked = 0.0, False


class Under(NamedTuple):
    """What the elements around a block say. ``outer``: above the topmost landmark, ``inner``: from it down."""

    low: float = 0.0                # of tags, roles and hiding
    high: float = 0.0
    landmark: int = 0               # number of the topmost article or main
    outer_word: float = 0.0
    outer_vague: bool = False
    comment: bool = False           # an outer word marks reader comments
    inner_word: float = 0.0
    inner_vague: bool = False
    nested: bool = False            # a landmark below a vague word


def _name_odds(value: str) -> tuple[float, bool]:
    """(log odds, whether vague) of the bad words of a class or id."""
    odds, vague = 0.0, False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        bad = _BAD_WORDS.intersection(words)
        if not bad or words[0] in _STATE_WORDS:
            continue
        if bad <= _VAGUE_WORDS and not _BAD_WORDS.issuperset(words):
            vague = True
        else:
            odds = _WORD_ODDS
    return odds, vague


def _element(tag: str, raw: str, inside: bool) -> tuple[float, float, bool, float, bool]:
    """Log odds of an element: the most negative by tag, role or hiding; by words; whether words are vague; the most
    positive; and whether words mark comments."""
    low = high = word = 0.0
    vague = comment = False
    odds = _TAG_ODDS.get(tag, 0.0)
    if tag == "header" and inside:
        odds = 0.0                                        # the header of an article holds its title
    low, high = min(low, odds), max(high, odds)
    if raw and not raw.isspace():
        for name, a, b, c in _ATTR.findall(raw):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                if words & _BAD_WORDS and tag not in ("html", "body", "article", "main"):
                    odds, maybe = _name_odds(value)
                    comment = comment or bool(words & _COMMENT_WORDS)
                    word, vague = min(word, odds), vague or maybe
                elif tag == "article" and words & {"comment", "comments", "ad", "advert", "promo"}:
                    word = _WORD_ODDS
                if words & _GOOD_WORDS:
                    high = max(high, 2.0)
            elif name == "role":
                odds = _ROLE_ODDS.get(value.strip().lower(), 0.0)
                low, high = min(low, odds), max(high, odds)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                low = min(low, -8.0)
    return low, word, vague, high, comment


def _below(outer: Under, own: tuple[float, float, bool, float, bool], number: int) -> Under:
    """What holds below an element, by its number in the page."""
    low, word, vague, high, comment = own
    landmark = high >= _LANDMARK
    outer = outer._replace(low=min(outer.low, low), high=max(outer.high, high))
    if not outer.landmark and not (landmark and not word):
        return outer._replace(outer_word=min(outer.outer_word, word), outer_vague=outer.outer_vague or vague,
                              comment=outer.comment or comment)
    nested = outer.nested or landmark and bool(outer.landmark) and outer.inner_vague
    return outer._replace(landmark=outer.landmark or number, inner_word=min(outer.inner_word, word),
                          inner_vague=outer.inner_vague or vague, nested=nested)


def _main_landmark(blocks: list[Block]) -> int:
    """The number of the page's main landmark (0: none): that with the most text outside links. One that lies in an
    element named like boilerplate comes after all others and needs half of the page's text; one in
    an element named like comments must be the only one besides."""
    size: dict[int, int] = {}
    spoiled: dict[int, Under] = {}
    whole = 0
    for b in blocks:
        u, n = b.under, int(len(b.text) * (1 - b.links))
        whole += n
        if u.landmark and not u.low and not u.inner_word and not u.nested:
            size[u.landmark] = size.get(u.landmark, 0) + n
        if u.landmark and u.outer_word:
            spoiled[u.landmark] = u
    good = {k: n for k, n in size.items() if k not in spoiled}
    if not good:
        good = {k: n for k, n in size.items() if 2 * n > whole and (len(size) == 1 or not spoiled[k].comment)}
    return max(good, key=lambda k: (good[k], -k)) if good else 0


def _prior(u: Under, main: int) -> tuple[float, bool]:
    """Log odds of a block and whether a clear landmark gives them."""
    own = main and u.landmark == main
    word = u.inner_word or (0.0 if own else u.outer_word)
    if not own and u.landmark and u.outer_vague or u.nested:
        word = word or _WORD_ODDS                         # teasers, comments
    if u.low or word:
        return u.low or word, True
    if u.inner_vague or u.outer_vague and not own:
        return _VAGUE_INSIDE if u.landmark else _VAGUE_ODDS, False
    return u.high, bool(u.high)


def parse_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with link share, DOM path and landmark odds."""
    blocks: list[Block] = []
    # an open element: tag, number, what holds below it, dropped, inside a link, inside article or main
    stack = [("", 0, Under(), False, False, False)]
    parts: list[str] = []
    linked = number = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(e[1] for e in stack if e[0] in _BLOCK)
                heading = any(e[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for e in stack[-4:])
                blocks.append(Block(text, min(1.0, linked / len(text)), path, heading, stack[-1][2]))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if not top[3] and text:
            if "&" in text:
                text = _html.unescape(text)
            parts.append(text)
            if top[4]:
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in _BLOCK:
                flush()
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth and not (tag not in _BLOCK and any(e[0] in _BLOCK for e in stack[depth + 1:])):
                del stack[depth:]
            continue
        raw = m["attrs"]
        if tag in _RAW and not raw.endswith("/"):
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in _BLOCK:
            flush()
            closes = _CLOSES[tag]
            while (depth := next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in _BLOCK), 0)) and stack[depth][0] in closes:
                del stack[depth:]
        elif tag == "br":
            add(" ")
        if tag == "body":                                 # whatever was open (a head without an end) is over
            del stack[1:]
        if tag in _VOID or raw.endswith("/"):
            continue
        _, _, odds, dropped, link, inside = stack[-1]
        number += 1
        stack.append((tag, number, _below(odds, _element(tag, raw, inside), number), dropped or tag in _DROPPED, link or tag == "a",
                      inside or tag in ("article", "main")))
    flush()
    main = _main_landmark(blocks)
    for b in blocks:
        b.odds, b.marked = _prior(b.under, main)
    return blocks


def block_features(blocks: list[Block]) -> list[list[float]]:
    """What the text of each block shows, each value about 0 to 1."""
    out, n = [], len(blocks)
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        stops = sum(map(b.text.count, ".,;:!?"))
        out.append([math.log1p(words) / 6, b.links, min(1.0, stops / words), float(b.text[-1] in ".!?"),
                    (k + 0.5) / n, float(b.heading), float("©" in b.text)])
    return out


N_FEATURES = 7


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the unpaid gains plus the weights of cut edges.

    ``gain > 0``: capacity from the source, ``< 0``: to the sink. Shortest augmenting paths
    level by level; whatever still reaches the sink in the residual graph is boilerplate, so
    undecided blocks stay.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, g in enumerate(gain):
        if g > 0:
            edge(source, k, g, 0.0)
        elif g < 0:
            edge(k, sink, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque((source,))
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:                                       # blocking flow, depth first without recursion
            if node == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            moves = out[node]
            while at[node] < len(moves):
                e = moves[at[node]]
                if cap[e] > tiny and level[to[e]] == level[node] + 1:
                    path.append(e)
                    node = to[e]
                    break
                at[node] += 1
            else:
                if node == source:
                    break
                level[node] = -1
                node = to[path.pop() ^ 1]
    lost = [False] * (n + 2)
    lost[sink] = True
    queue = deque((sink,))
    while queue:
        b = queue.popleft()
        for e in out[b]:
            if cap[e ^ 1] > tiny and not lost[to[e]]:
                lost[to[e]] = True
                queue.append(to[e])
    return [not x for x in lost[:n]]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page and between neighbours under one parent."""
    edges = []
    last: dict[tuple, int] = {}
    for k, b in enumerate(blocks):
        parent = b.path[:-1]
        if k:
            other = blocks[k - 1].path
            same = 0
            for x, y in zip(b.path, other):
                if x != y:
                    break
                same += 1
            far = len(b.path) + len(other) - 2 * same     # steps through the common ancestor
            edges.append((k - 1, k, _LINK * _FAR / (_FAR + far)))
        if parent in last:
            edges.append((last[parent], k, _SAME_PARENT))
        last[parent] = k
    return edges


def extract(page: str | None, weights: list[float]) -> str:
    """The main text of one page: content blocks joined by an empty line."""
    blocks = parse_blocks(page or "")
    if not blocks:
        return ""
    gain = []
    for b, f in zip(blocks, block_features(blocks)):
        z = weights[-1] + sum(w * x for w, x in zip(weights, f))
        gain.append(max(-3.0, min(3.0, z)) + b.odds)
    keep = min_cut(gain, smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def fit_classifier(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> list[float]:
    """Weights (last: intercept) of the text classifier, from blocks with clear landmarks of a bounded sample."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    # distinct pages whose hash lies in a range that holds about ``fit_pages`` rows, twice as many at most
    share = min(1.0, fit_pages / max(1, pages.count()))
    low = F.xxhash64(html_col) <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))
    sample = pages.filter(F.length(html_col) > 0).filter(low).select(F.col(html_col).alias("_html")).distinct().limit(2 * fit_pages)

    def rows(stream):
        import pyarrow as pa

        for batch in stream:
            found = [(x, float(b.odds > 0)) for page in batch.column(0).to_pylist() for blocks in (parse_blocks(page),)
                     for b, x in zip(blocks, block_features(blocks)) if b.marked]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.float64())),
                                              pa.array([y for _, y in found], pa.float64())], ["x", "label"])

    data = sample.mapInArrow(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    data = data.persist()
    try:
        if data.select("label").distinct().count() < 2:   # nothing to tell apart: landmarks and smoothing decide
            return [0.0] * (N_FEATURES + 1)
        model = LogisticRegression(maxIter=25, regParam=0.01, standardization=False).fit(data)
        return [float(w) for w in model.coefficients] + [float(model.intercept)]
    finally:
        data.unpersist()


def main_text(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES,
              weights: list[float] | None = None) -> DataFrame:
    """All rows and columns of ``pages`` without the html, plus ``text`` and ``n_chars``.

    Columns named ``text`` or ``n_chars`` are replaced.
    """
    weights = weights or fit_classifier(pages, html_col, fit_pages)
    keep = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]

    def batches(stream):
        import pyarrow as pa

        for batch in stream:
            texts = [extract(page, weights) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k + 1) for k in range(len(keep))), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in keep), "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType
    schema = StructType([*keep, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(F.col(html_col), *[F.col(f"`{f.name}`") for f in keep]).mapInArrow(batches, schema)


def op7(pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html"))
