"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

Pages become trees of block elements; inline markup only counts. Trees of a boosted model score every element from
its density, attribute words, depth and siblings. Decoding keeps the elements with the largest total score such that
a kept element's ancestors are kept too. The model is trained on pages of the table that mark their article, each also
in variants that rename the marking elements and add notices, sidebars, forms and comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ship

#: The model is trained on so many pages and so many characters of HTML, at most.
SAMPLE_PAGES = 240
SAMPLE_CHARS = 4_000_000
TREES = 50
DEPTH = 4
BINS = 32

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text.
SKIPPED = set("script style noscript template svg math iframe object canvas head title textarea select button audio video map datalist".split())
RAW = set("script style textarea title noscript template iframe".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GROUPS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset", "h1 h2 h3 h4 h5 h6", "p blockquote pre", "ul ol dl", "li dt dd", "div section", "table tbody thead tr td th figure figcaption"]
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
AGAINST = set(
    "nav navbar navigation menu header masthead topbar footer bottom sidebar side aside ad ads advert advertisement adverts sponsored sponsor banner promo "
    "comment comments reply replies discussion disqus cookie cookies consent notice alert warning gdpr form search login signup subscribe newsletter "
    "related recommended share sharing social breadcrumb breadcrumbs widget popup modal overlay pagination pager copyright legal tags meta toolbar skip"
    .split()
)
IN_FAVOUR = set("article articlebody content post entry story main body text maincontent".split())


class Node:
    """A block element: its text pieces and children in page order, and what its inline markup holds."""

    __slots__ = ("tag", "words", "parent", "items", "depth", "links", "tags", "place", "number")

    def __init__(self, tag: str, words: frozenset[str], parent: Node | None) -> None:
        self.tag, self.words, self.parent = tag, words, parent
        self.items: list[Node | str | None] = []  # None is a line break
        self.depth = 0 if parent is None else parent.depth + 1
        self.links = self.tags = self.place = 0
        self.number = -1


def _attribute_words(attributes: str) -> frozenset[str]:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "hidden":
            found.add("popup")
        for w in _WORDS.findall(m[2] or m[3] or m[4] or ""):
            found.add(w.lower())
    return frozenset(found)


def parse(page: str) -> Node:
    """The tree of a page's block elements. Unclosed and unmatched tags are put up with."""
    root = node = Node("html", frozenset(), None)
    in_link = 0
    at = 0
    skip_until = None
    for m in _MARKUP.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            node.items.append(text)
            if in_link:
                node.links += len(text.strip())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in INLINE or tag in VOID:
                continue
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
                in_link = 0
            continue
        if tag in SKIPPED:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = len(page)
                break
            continue
        node.tags += 1
        if tag in ("br", "hr"):
            node.items.append(None)
        elif tag == "a":
            in_link = 1
        if tag in INLINE or tag in VOID:
            continue
        if tag in ("html", "body"):
            if tag == "body" and all(not isinstance(x, Node) for x in root.items):
                root.words = root.words | _attribute_words(m[3])
            continue
        closing = CLOSES.get(tag)
        if node.tag == "p":
            node = node.parent
        elif closing:
            up = node
            while up.parent is not None and up.tag not in closing and up.tag not in ("ul", "ol", "dl", "table"):
                up = up.parent
            if up.tag in closing:
                node = up.parent
        child = Node(tag, _attribute_words(m[3]), node)
        node.items.append(child)
        if m[0].endswith("/>") and tag not in ("p", "div"):
            continue
        node = child
        in_link = 0
    if at < len(page):
        node.items.append(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", page[at:])))
    return root


def nodes(root: Node) -> list[Node]:
    """All elements in page order, each with its number."""
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        n.number = len(found)
        found.append(n)
        stack += [x for x in reversed(n.items) if isinstance(x, Node)]
    return found


def features(*trees: list[Node]) -> np.ndarray:
    """One row per element of some pages: its own figures, those of its subtree, its siblings and its ancestors."""
    all_nodes = [x for t in trees for x in t]
    n = len(all_nodes)
    starts = np.cumsum([0, *map(len, trees)])
    page = np.repeat(np.arange(len(trees)), np.diff(starts))
    parent = np.array([-1 if x.parent is None else x.parent.number for x in all_nodes])
    parent = np.where(parent >= 0, parent + starts[page], -1)
    texts = [[t for t in x.items if t.__class__ is str] for x in all_nodes]
    own = np.array([sum([len(t.strip()) for t in ts]) for ts in texts], float)
    marks = np.array([sum([t.count(".") + t.count(",") for t in ts]) for ts in texts], float)
    links = np.array([x.links for x in all_nodes], float)
    tags = np.array([x.tags for x in all_nodes], float)
    group = np.array([_GROUP.get(x.tag, -1) for x in all_nodes])
    bad = np.array([len(x.words & AGAINST) for x in all_nodes], float)
    good = np.array([len(x.words & IN_FAVOUR) for x in all_nodes], float)
    depth = np.array([x.depth for x in all_nodes], float)
    tag = {t: i for i, t in enumerate({x.tag for x in all_nodes})}
    tags_of = np.array([tag[x.tag] for x in all_nodes])
    before = np.cumsum(own) - own
    before -= before[starts[:-1]][page]
    total = {k: v.copy() for k, v in (("own", own), ("marks", marks), ("links", links), ("tags", tags), ("full", (own > 0).astype(float)))}
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for rows in levels[:0:-1]:  # from the leaves up
        for v in total.values():
            np.add.at(v, parent[rows], v[rows])
    bad_up, good_up = np.zeros(n), np.zeros(n)
    inside = np.zeros((n, 6))
    for d, rows in enumerate(levels):  # from the root down
        if d:
            p = parent[rows]
            bad_up[rows], good_up[rows] = bad_up[p] + bad[p], good_up[p] + good[p]
            inside[rows] = inside[p]
        special = rows[(group[rows] >= 0) & (group[rows] < 6)]
        inside[special, group[special]] = 1
    order = np.argsort(parent, kind="stable")
    family = parent[order]
    opens = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]]))
    size = np.diff(np.concatenate([opens, [n]]))
    rank, count, around = np.zeros(n), np.ones(n), np.zeros(n)
    count[order] = np.repeat(size, size)
    rank[order] = (np.arange(n) - np.repeat(opens, size)) / count[order]
    around[order] = np.repeat(np.add.reduceat(total["own"][order], opens) / size, size)
    _, kind, of_kind = np.unique(parent * (len(tag) + 1) + tags_of, return_inverse=True, return_counts=True)
    alike = of_kind[kind] / count
    roots = parent < 0
    rank[roots], count[roots], around[roots], alike[roots] = 0, 1, 0, 1
    chars = total["own"]
    of_page = np.maximum(1.0, chars[starts[:-1]])[page]
    one_hot = np.zeros((n, len(GROUPS)))
    one_hot[np.flatnonzero(group >= 0), group[group >= 0]] = 1
    columns = [
        depth, np.log1p(chars), np.log1p(own), total["links"] / (chars + 1), total["tags"] / (chars + 1), chars / of_page, before / of_page,
        total["marks"] / (chars + 1), chars / (total["full"] + 1), bad, bad_up, good, good_up, rank, np.log1p(count), alike, np.log1p(around),
    ]
    return np.column_stack([*columns, inside, one_hot])


class Trees(NamedTuple):
    """Boosted trees of one depth: per tree and inner node a feature and a limit, per leaf a value."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = 0.25) -> Trees:
    """Logistic boosting with histograms of each feature's quantiles."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # x <= edge goes left
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    inner = (1 << depth) - 1
    feature, limit, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-9
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            local = at - first
            best = np.full(n, 1e-6)
            base_g, base_h = np.bincount(local, g, n), np.bincount(local, h, n)
            base = base_g**2 / (base_h + 1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * BINS + binned[:, f]
                left_g = np.bincount(cell, g, n * BINS).reshape(n, BINS).cumsum(axis=1)[:, : len(e)]
                left_h = np.bincount(cell, h, n * BINS).reshape(n, BINS).cumsum(axis=1)[:, : len(e)]
                right_h = base_h[:, None] - left_h
                gain = left_g**2 / (left_h + 1) + (base_g[:, None] - left_g) ** 2 / (right_h + 1) - base[:, None]
                gain[(left_h < 0.5) | (right_h < 0.5)] = 0
                top = gain.argmax(axis=1)
                for j in np.flatnonzero(gain[np.arange(n), top] > best).tolist():
                    best[j] = gain[j, top[j]]
                    feature[t, first + j], limit[t, first + j] = f, e[top[j]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[t, at]] > limit[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[t, leaf]
    return Trees(feature, limit, value, start)


def margins(model: Trees, x: np.ndarray) -> np.ndarray:
    """The log odds of each row."""
    inner = model.feature.shape[1]
    rows = np.arange(len(x))
    total = np.full(len(x), model.start)
    for f, limit, value in zip(model.feature, model.limit, model.value, strict=True):
        at = np.zeros(len(x), np.int64)
        while len(x) and at[0] < inner:
            at = 2 * at + 1 + (x[rows, f[at]] > limit[at])
        total += value[at - inner]
    return total


def decode(all_nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The elements to keep: the largest total of odds, longer texts weighing more, no kept element under a dropped one."""
    sizes = [sum([len(t) for t in x.items if t.__class__ is str]) for x in all_nodes]
    gain = (odds * (1 + np.log1p(sizes))).tolist()
    parent = [-1 if x.parent is None else x.parent.number for x in all_nodes]
    for i in range(len(all_nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = [g > 0 for g in gain]
    for i in range(1, len(all_nodes)):
        keep[i] = keep[i] and keep[parent[i]]
    return np.array(keep)


def blocks(root: Node, keep: np.ndarray) -> list[str]:
    """The kept elements' texts in page order: one for each run of text between element borders and line breaks."""
    found: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            found.append(text)
        held.clear()

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0:
            flush()
            if not keep[node.number]:
                continue
        for j in range(i, len(node.items)):
            item = node.items[j]
            if item is None:
                flush()
            elif isinstance(item, str):
                held.append(item)
            else:
                stack += [(node, j + 1), (item, 0)]
                break
        else:
            flush()
    return found


def main_text(model: Trees, page: str | None) -> str:
    """The main text of a page; empty for a null or empty page, or one without main text."""
    if not page:
        return ""
    root = parse(page)
    all_nodes = nodes(root)
    return "\n".join(blocks(root, decode(all_nodes, margins(model, features(all_nodes)))))


def truth(all_nodes: list[Node]) -> np.ndarray | None:
    """Which elements hold main text on a page that marks it with article, main or a role; None on others."""
    n = len(all_nodes)
    inside = np.zeros(n, bool)
    for i, x in enumerate(all_nodes):
        up = x.parent is not None and inside[x.parent.number]
        opens = x.tag in ("article", "main") or bool(x.words & {"articlebody"})
        closes = x.tag in ("nav", "footer", "aside", "form") or bool(x.words & AGAINST)
        inside[i] = (up or opens) and not closes
    if not inside.any():
        return None
    holds = inside.copy()
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[all_nodes[i].parent.number] = True
    return holds


_NAMES = {
    "article": ["content", "post", "entry-content", "story", "article-body", "main-text", "", "", "container"],
    "nav": ["menu", "navbar", "top-menu", "links", "", "navigation"],
    "footer": ["footer", "bottom", "copyright", "", "page-footer"],
}
_EXTRA = [
    ("header", "", "site"), ("div", "header", "site"), ("aside", "", "links"), ("div", "sidebar", "links"), ("div", "widget related", "links"), ("div", "cookie-notice", "short"),
    ("section", "comments", "long"), ("div", "comment-list", "long"), ("form", "search", "short"), ("form", "", "short"), ("div", "ad banner", "short"), ("div", "newsletter", "short"),
    ("div", "notice", "short"), ("ul", "social share", "links"), ("div", "sponsored", "long"), ("div", "breadcrumbs", "links"), ("aside", "", "long"), ("div", "alert", "long"),
]


def variant(root: Node, holds: np.ndarray, texts: list[str], rng: np.random.Generator) -> tuple[list[Node], np.ndarray]:
    """The same page with other names for its parts and with parts added that are no main text."""
    label = {id(x): bool(holds[x.number]) for x in nodes(root)}
    for x in nodes(root):
        if x.tag in _NAMES and rng.random() < 0.7:
            name = _NAMES[x.tag][rng.integers(len(_NAMES[x.tag]))]
            x.tag = "div" if rng.random() < 0.8 else "section"
            x.words = frozenset(w.lower() for w in _WORDS.findall(name))
        elif x.tag == "div" and x.words and rng.random() < 0.3:
            x.words = frozenset()

    def some(kind: str) -> str:
        words = texts[rng.integers(len(texts))].split()
        n = {"site": 4, "links": 2, "short": 12, "long": 60}[kind]
        at = rng.integers(max(1, len(words) - n))
        return " ".join(words[at : at + n])

    for k in rng.choice(len(_EXTRA), size=rng.integers(0, 6), replace=False):
        tag, name, kind = _EXTRA[k]
        up = root
        inner = [x for x in nodes(root) if label.get(id(x)) and x.tag in ("article", "div", "section", "main")]
        if inner and rng.random() < 0.3:
            up = inner[rng.integers(len(inner))]
        extra = Node(tag, frozenset(_WORDS.findall(name)), up)
        label[id(extra)] = False
        for _ in range(rng.integers(1, 7)):
            child = Node("li" if kind == "links" else "p", frozenset(), extra)
            child.items.append(some(kind))
            label[id(child)] = False
            if kind == "links":
                child.links, child.tags = len(child.items[0]), 1
            extra.items.append(child)
        up.items.insert(int(rng.integers(len(up.items) + 1)), extra)
    if rng.random() < 0.3:  # a wrapper around everything
        wrapper = Node("div", frozenset({"wrapper"}), root)
        wrapper.items, root.items = root.items, [wrapper]
        label[id(wrapper)] = True
        for x in wrapper.items:
            if isinstance(x, Node):
                x.parent = wrapper
    stack = [root]
    while stack:
        x = stack.pop()
        x.depth = 0 if x.parent is None else x.parent.depth + 1
        stack += [c for c in x.items if isinstance(c, Node)]
    all_nodes = nodes(root)
    return all_nodes, np.array([label[id(x)] for x in all_nodes])


def fit(pages: list[str], variants: int = 4, seed: int = 5) -> Trees:
    """A model from whole pages; those that do not mark their article teach nothing. Without any, all text is kept."""
    rng = np.random.default_rng(seed)
    marked = [(p, h) for p in pages if (h := truth(nodes(parse(p)))) is not None]
    texts = [t for p, h in marked for t in blocks(parse(p), np.ones(len(h), bool))] if marked else []
    texts = [t for t in texts if t] or ["-"]
    rows, labels = [], []
    for page, holds in marked:
        rows.append(features(nodes(parse(page))))
        labels.append(holds)
        for _ in range(variants):
            root = parse(page)
            nodes(root)
            all_nodes, y = variant(root, holds, texts, rng)
            rows.append(features(all_nodes))
            labels.append(y)
    if not rows:
        return Trees(np.zeros((0, 1), np.int32), np.zeros((0, 1)), np.zeros((0, 2)), 1.0)
    return boost(np.concatenate(rows), np.concatenate(labels).astype(float))


def training_pages(pages: DataFrame, html_col: str = "html", most_pages: int = SAMPLE_PAGES, most_chars: int = SAMPLE_CHARS) -> list[str]:
    """Different pages with the smallest hashes, whole; their number and total length are bounded by the parameters."""
    rows = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(html_col).alias("h"), F.length(html_col).alias("n"))
    total, last = 0, None
    for r in rows.distinct().orderBy("h", "n").limit(most_pages).collect():
        total += r["n"]
        if total > most_chars and last is not None:
            break
        last = r["h"]
    if last is None:
        return []
    picked = pages.where(F.xxhash64(html_col) <= last).select(F.col(html_col).alias("html")).distinct()
    return [r["html"] for r in picked.orderBy("html").collect()]


def extract(pages: DataFrame, model: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none). Whole pages are read; rows that repeat are each answered."""
    ship(pages.sparkSession)
    data = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            for first in range(0, batch.num_rows, 256):
                trees, roots = [], []
                part = [column[i].as_py() for i in range(first, min(batch.num_rows, first + 256))]
                for page in part:
                    root = parse(page or "")
                    roots.append(root)
                    trees.append(nodes(root))
                odds = margins(shared.value, features(*trees))
                cuts = np.cumsum([len(t) for t in trees])[:-1]
                found = ["\n".join(blocks(r, decode(t, o))) for r, t, o in zip(roots, trees, np.split(odds, cuts), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(part)) for c in ("page_id", "url")), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return data.mapInArrow(run, "page_id long, url string, text string")
