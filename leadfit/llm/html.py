"""Main text of web pages: boosted trees over features of DOM nodes, decoded over the whole tree.

Every element gets a probability of belonging to the article from its own features (tag, attribute words, depth,
siblings, density of text and links of its subtree). The decoding keeps an element only if all its ancestors are kept and
picks the consistent choice of highest total log-odds, so a block inside a rejected menu can't come back, and an article
isn't lost for one odd wrapper.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^<]*\Z|[^<]+|<", re.S)
TAG = re.compile(r"</?[a-zA-Z]")
NAME_END = re.compile(r"[\s/>]")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ATTRIBUTE_WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements by how they are parsed and shown
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select body".split())
SCOPES = frozenset("article aside section div main nav header footer form table ul ol dl body html blockquote td li".split())

# Words of tags and of class, id and role attributes by which nodes are labelled for learning
ARTICLE_WORDS = frozenset("article main content post entry story text body blog news".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert advertisement banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended popular share sharing social comment comments reply "
    "replies disqus cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup login form "
    "search pagination pager toolbar skip hidden copyright legal tags".split())
OTHER_TAGS = frozenset("nav header footer aside form script style button select input textarea noscript template iframe head title dialog menu svg canvas object".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())  # like inline elements, never left out for their names alone
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("script style noscript template iframe head title textarea xmp noembed noframes svg canvas object math".split())

TAGS = "article main section div p h1 h2 h3 h4 ul ol li table blockquote pre figure header footer nav aside form script style head title span a b other".split()
TAG_PLACE = {t: i for i, t in enumerate(TAGS)}
NUMBERS = ["depth", "index", "siblings", "same_tag_siblings", "children", "elements", "text", "own_text", "link_share", "text_per_element", "share_of_page", "paragraphs", "article_words", "other_words", "attribute_words", "ends", "words_per_block", "position"]
SAMPLE_PAGES = 1500  # bound of the pages that are learnt from
NODES_OF_A_PAGE = 400  # bound of the nodes of one page that are learnt from, evenly spread over it
NODES_AT_ONCE = 1 << 14  # nodes of pages that go through the trees together
TREES, DEPTH, RATE, BINS = 30, 4, 0.3, 32


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset[str] = frozenset()
    items: list[str | int] = field(default_factory=list)  # texts and places of child nodes, in page order


class _Open:
    """The open elements, the root first, and for each tag the places where it is open, so that no search walks over them."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack = nodes, [0]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]

    def push(self, node: int) -> None:
        tag = self.nodes[node].tag
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int, beyond: int) -> None:
        """Ends the element at a place, with all inside it, if the place lies beyond another."""
        if place <= beyond:
            return
        while len(self.stack) > place:
            tag = self.nodes[self.stack.pop()].tag
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()


class _Ends:
    """Which tags of a page end at all: a tag ends at the first > outside quotes. All tags are settled from the back in
    one pass over the marks, so that a page of tags that never end is not searched to its end for each of them."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.start() for m in MARK.finditer(text)]
        self.names = [m.start() for m in NAME_END.finditer(text)]
        outside = double = single = False
        ends = []
        for p in reversed(self.at):
            c = text[p]
            outside, double, single = (True if c == ">" else double if c == '"' else single), (outside if c == '"' else double), (outside if c == "'" else single)
            ends.append(outside)
        self.ends = ends[::-1]

    def __call__(self, start: int) -> bool:
        """Whether the tag that begins here ends; its name runs up to white space, / or >."""
        k = bisect_left(self.names, start + 2)
        mark = bisect_left(self.at, self.names[k]) if k < len(self.names) else len(self.at)
        return mark < len(self.at) and self.ends[mark]


def parse(page: str | None) -> list[Node]:
    """Nodes of a page in page order, the root first; open elements end where HTML lets them end, stray ends are passed over.

    Takes time in proportion to the page, whatever it holds."""
    nodes = [Node("#root", -1)]
    open_ = _Open(nodes)
    stack = open_.stack
    text = page or ""
    at, n = 0, len(text)
    ends_at_all: _Ends | None = None
    while at < n:
        if ends_at_all and TAG.match(text, at) and not ends_at_all(at):
            rest = text.find("<", at + 1)
            if rest >= 0:  # the tag is text; the last one of a page is dropped
                nodes[stack[-1]].items.append(text[at:rest])
            at = rest if rest >= 0 else n
            continue
        m = TOKEN.match(text, at)
        at = m.end() if m else at + 1
        if m is None or m.group(2) is None:
            piece = m.group() if m else text[at - 1]
            if piece == "<" and ends_at_all is None:
                ends_at_all = _Ends(text)
            if piece[0] != "<" or piece == "<":
                nodes[stack[-1]].items.append(piece)
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if closing:
            open_.close(open_.nearest((tag,)), 0 if tag in SCOPES else open_.scopes[-1])
            continue
        if tag in CLOSED_BY_BLOCK:
            open_.close(open_.nearest("p"), open_.scopes[-1])
        if tag in SIBLING_ENDS:
            open_.close(open_.nearest(SIBLING_ENDS[tag]), open_.nearest(LISTS))
        words: set[str] = set()
        if attributes and not attributes.isspace():
            for a in ATTRIBUTE.finditer(attributes):
                if a.group(1).lower() in ("class", "id", "role", "itemprop"):
                    words.update(ATTRIBUTE_WORD.findall((a.group(2) or a.group(3) or a.group(4) or "").lower()))
        nodes.append(Node(tag, stack[-1], frozenset(words)))
        nodes[stack[-1]].items.append(len(nodes) - 1)
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(text, at)
            nodes[-1].items.append(text[at:end.start() if end else n])
            close = text.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and not attributes.endswith("/"):
            open_.push(len(nodes) - 1)
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node: NUMBERS, then the tag as indicator."""
    n = len(nodes)
    table = np.zeros((n, len(NUMBERS) + len(TAGS)))
    own, text, link, elements, paragraphs, ends, children = (np.zeros(n) for _ in range(7))
    depth, index, first_text = np.zeros(n), np.zeros(n), np.zeros(n)
    tag_counts: list[dict[str, int]] = [{} for _ in range(n)]
    so_far = 0.0
    for i, node in enumerate(nodes):
        p = node.parent
        if p >= 0:
            depth[i] = depth[p] + 1
            index[i] = children[p]
            children[p] += 1
            tag_counts[p][node.tag] = tag_counts[p].get(node.tag, 0) + 1
        for x in node.items:
            if isinstance(x, str):
                size = len(x) - x.count(" ") - x.count("\n")
                own[i] += size
                ends[i] += x.count(". ") + x.count("! ") + x.count("? ") + x.rstrip().endswith((".", "!", "?"))
        first_text[i] = so_far
        so_far += own[i] if node.tag not in NEVER else 0
    visible = np.array([node.tag not in NEVER for node in nodes])
    text[:] = np.where(visible, own, 0)
    link[:] = [text[i] if node.tag == "a" else 0 for i, node in enumerate(nodes)]
    paragraphs[:] = [node.tag == "p" for node in nodes]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i] if visible[i] else 0
        link[p] += text[i] if nodes[i].tag == "a" else link[i]
        elements[p] += elements[i] + 1
        paragraphs[p] += paragraphs[i]
        ends[p] += ends[i] if visible[i] else 0
    whole = max(text[0], 1.0)
    parent = np.array([max(node.parent, 0) for node in nodes])
    columns = {
        "depth": depth, "index": index, "siblings": children[parent] - 1,
        "same_tag_siblings": [tag_counts[p].get(node.tag, 1) - 1 for p, node in zip(parent.tolist(), nodes)],
        "children": children, "elements": elements, "text": np.log1p(text), "own_text": np.log1p(own),
        "link_share": link / np.maximum(text, 1), "text_per_element": text / (elements + 1), "share_of_page": text / whole,
        "paragraphs": paragraphs, "article_words": [len(node.words & ARTICLE_WORDS) for node in nodes],
        "other_words": [len(node.words & OTHER_WORDS) for node in nodes], "attribute_words": [len(node.words) for node in nodes],
        "ends": np.log1p(ends), "words_per_block": text / np.maximum(paragraphs, 1), "position": first_text / whole,
    }
    for j, name in enumerate(NUMBERS):
        table[:, j] = columns[name]
    place = [TAG_PLACE.get(node.tag, TAG_PLACE["other"]) for node in nodes]
    table[np.arange(n), len(NUMBERS) + np.array(place)] = 1
    return table


def seed_labels(nodes: list[Node], other: np.ndarray) -> np.ndarray:
    """1 inside a node that names itself an article, 0 inside one of `other`, the nearest such ancestor or the node itself
    counting; -1 where no name tells. Elements around an article are part of its way: 1."""
    n = len(nodes)
    out = np.full(n, -1)
    for i, node in enumerate(nodes):
        p = node.parent
        if other[i]:
            out[i] = 0
        elif p >= 0 and out[p] == 0:
            out[i] = 0
        elif node.tag in ("article", "main") or node.words & ARTICLE_WORDS:
            out[i] = 1
        elif p >= 0 and out[p] == 1:
            out[i] = 1
    for i in range(n - 1, 0, -1):
        if out[i] == 1 and out[nodes[i].parent] == -1:
            out[nodes[i].parent] = 2
        elif out[i] == 2 and out[nodes[i].parent] == -1:
            out[nodes[i].parent] = 2
    return np.where(out == 2, 1, out)


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees of a fixed depth as arrays: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def logits(self, table: np.ndarray) -> np.ndarray:
        out = np.full(len(table), self.base)
        rows = np.arange(len(table))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(table), np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (table[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit_trees(table: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss: Newton leaves, best split of each node over BINS quantiles of a feature."""
    n, width = table.shape
    cuts = [np.unique(np.quantile(table[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, table[:, j], "left").astype(np.uint8) for j, c in enumerate(cuts)], axis=1)
    mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    inner = 2**DEPTH - 1
    features_, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best, choice = 1e-6, None
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(cuts[j]) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, choice = gain[k], (j, cuts[j][k])
            if choice:
                f[node], t[node] = choice
            at[rows] = 2 * node + 1 + (table[rows, f[node]] > t[node])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        v = -RATE * gs / (hs + 1)
        score += v[leaf]
        features_.append(f)
        thresholds.append(t)
        values.append(v)
    return Trees(base, np.array(features_), np.array(thresholds), np.array(values))


def named_other(nodes: list[Node], share: np.ndarray) -> np.ndarray:
    """Nodes that hold no text to read, and blocks whose tag or names say that they are not the article.

    Left to the trees, whatever their names: inline elements, paragraphs and headings; a node that holds most of the
    page's text; the header of an article or main element that holds a heading; a nav, header, footer or aside that holds
    an article or main element; a named node that holds one, or a node with a name of articles, or that has such a name
    itself; a form that holds either.
    """
    n = len(nodes)
    tagged, named, headed, inside = (np.zeros(n, bool) for _ in range(4))
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        tagged[node.parent] |= tagged[i] or node.tag in ("article", "main")
        named[node.parent] |= named[i] or bool(node.words & ARTICLE_WORDS and not node.words & OTHER_WORDS and node.tag not in OTHER_TAGS)
        headed[node.parent] |= headed[i] or node.tag in HEADINGS
    for i in range(1, n):
        p = nodes[i].parent
        inside[i] = nodes[p].tag in ("article", "main") or inside[p] and nodes[p].tag not in OTHER_TAGS
    out = []
    for node, t, a, h, within, s in zip(nodes, tagged.tolist(), named.tolist(), headed.tolist(), inside.tolist(), share.tolist()):
        free = node.tag in INLINE or node.tag in TEXT_BLOCKS or s > 0.5 or within and h and (node.tag == "header" or "header" in node.words)
        by_tag = node.tag in OTHER_TAGS and not t and not (node.tag == "form" and a)
        frame = t or a or node.words & ARTICLE_WORDS or node.tag in ("article", "main", "body", "html")
        out.append(node.tag in NEVER or not free and (by_tag or bool(node.words & OTHER_WORDS and not frame)))
    return np.array(out, bool)


def decode(nodes: list[Node], logits: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the choice of highest total of log-odds (for kept nodes, against dropped ones) in which the
    parent of a kept node is kept. Nodes of `other` are dropped; inline elements go with their parents; the root is kept."""
    inline = np.array([node.tag in INLINE for node in nodes])
    gain = np.where(other, -np.inf, np.where(inline, 0.0, logits))
    gain[0] = 0.0
    total = gain.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if total[i] > 0:
            total[nodes[i].parent] += total[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and (total[i] > 0 or bool(inline[i]) and not other[i])
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Texts of kept nodes: references decoded, white space inside a block one blank, blocks on lines of their own.

    A block ends where a block element or br begins or ends."""
    blocks: list[list[str]] = [[]]
    work: list[tuple[int, int]] = [(0, 0)]
    while work:
        i, k = work.pop()
        node = nodes[i]
        breaks = node.tag not in INLINE
        if breaks and k == 0:
            blocks.append([])
        items = node.items
        while k < len(items) and isinstance(items[k], str):
            blocks[-1].append(items[k])
            k += 1
        if k < len(items):
            work.append((i, k + 1))
            if kept[items[k]]:
                work.append((items[k], 0))
            elif nodes[items[k]].tag not in INLINE:
                blocks.append([])
        elif breaks:
            blocks.append([])
    lines = (SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def fit_extractor(pages: DataFrame, most: int = SAMPLE_PAGES, most_nodes: int = NODES_OF_A_PAGE) -> Trees | None:
    """Trees from nodes whose own or whose ancestors' names tell what they are, on at most `most` pages (first by a hash
    of the url and id) and `most_nodes` nodes of each, evenly spread. None where no page has nodes of both kinds. Of
    several rows of one url and id the html of the smallest hash is learnt from.

    In half of the sample the names are taken away (attribute words, and the tags article, main, nav, header, footer,
    aside, form), and in half of those paragraphs and headings too, so that the trees also learn what such nodes look
    like by their text and place.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    order = F.xxhash64("page_id", "url")
    ids = rows.where(F.length("html") > 0).select("page_id", "url", order.alias("o")).distinct().orderBy("o", "page_id", "url").limit(most)
    picked = rows.join(F.broadcast(ids.select("page_id", "url")), ["page_id", "url"])
    picked = picked.groupBy("page_id", "url").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for page_id, page in zip(t["page_id"], t["html"]):
                nodes = parse(page)
                x = features(nodes)
                y = seed_labels(nodes, named_other(nodes, x[:, NUMBERS.index("share_of_page")]))
                told = np.flatnonzero(y >= 0)
                told = told[np.linspace(0, len(told) - 1, min(len(told), most_nodes)).astype(int)] if len(told) else told
                x, y = x[told], y[told]
                if int(page_id) % 2:
                    x[:, [NUMBERS.index(c) for c in ("article_words", "other_words", "attribute_words")]] = 0
                    named = [len(NUMBERS) + TAG_PLACE[c] for c in ("article", "main", "nav", "header", "footer", "aside", "form")]
                    x[:, len(NUMBERS) + TAG_PLACE["div"]] += x[:, named].sum(axis=1)
                    x[:, named] = 0
                if int(page_id) % 4 == 3:  # pages of div alone
                    blocks = [len(NUMBERS) + TAG_PLACE[c] for c in ("p", "h1", "h2", "h3", "h4", "section")]
                    x[:, len(NUMBERS) + TAG_PLACE["div"]] += x[:, blocks].sum(axis=1)
                    x[:, [*blocks, NUMBERS.index("paragraphs")]] = 0
                    x[:, NUMBERS.index("words_per_block")] = np.expm1(x[:, NUMBERS.index("text")])
                out.append((y.astype(np.uint8).tobytes(), x.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["y", "x"])

    # at most most * most_nodes rows of numbers, as bytes
    found = picked.where(F.col("page_id").isNotNull()).mapInPandas(learn, "y binary, x binary").collect()
    y = np.frombuffer(b"".join(r["y"] for r in found), np.uint8).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.frombuffer(b"".join(r["x"] for r in found), np.float32).reshape(len(y), -1)
    weight = np.concatenate([np.full(len(r["y"]), 1.0 / max(len(r["y"]), 1)) for r in found])
    weight = weight * np.where(y == 1, 0.5 / weight[y == 1].sum(), 0.5 / weight[y == 0].sum()) * len(y)
    order = np.lexsort((*x.T[::-1], y))  # rows come in any order
    return fit_trees(x[order], y[order], weight[order])


def extract_all(pages: Iterable[str | None], trees: Trees | None) -> Iterator[str]:
    """Main text of each page; the nodes of several pages go through the trees together."""
    held: list[tuple[list[Node], np.ndarray, np.ndarray]] = []

    def texts() -> Iterator[str]:
        logits = trees.logits(np.concatenate([t for _, t, _ in held])) if trees is not None and held else None
        at = 0
        for nodes, table, other in held:
            own = np.where(seed_labels(nodes, other) == 0, -1.0, 1.0) if logits is None else logits[at:at + len(nodes)]
            at += len(nodes)
            yield text_of(nodes, decode(nodes, own, other))

    waiting = 0
    for page in pages:
        nodes = parse(page)
        table = features(nodes)
        held.append((nodes, table.astype(np.float32), named_other(nodes, table[:, NUMBERS.index("share_of_page")])))
        waiting += len(nodes)
        if waiting >= NODES_AT_ONCE:
            yield from texts()
            held, waiting = [], 0
    yield from texts()


def extract(page: str | None, trees: Trees | None) -> str:
    return next(extract_all([page], trees))


def main_text(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages, from the whole html.

    A null or empty html gives an empty text; null ids and urls stay null; repeated rows give repeated rows; an empty
    table gives an empty one; other columns are ignored. The trees have a fixed size. No shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return pd.Series([*extract_all(htmls, shared.value)], dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text(F.col("html").cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
