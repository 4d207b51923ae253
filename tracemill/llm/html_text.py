"""Main text of web pages: boosted trees over block nodes, decoded along the tree.

A page is read into a tree of block elements. Each node is described by its subtree (text, nodes, density,
links), its depth, siblings, parent and kind of block. Gradient-boosted trees give the probability that
it belongs to the main text; decoding then picks the likeliest set of nodes in which no node is kept under
one that is not, so an article's advert goes with all inside it and nothing of a menu comes back.

No page carries labels. The trees learn from pages whose authors said what parts are: nodes whose nearest
telling element name or attribute token names main content, against nodes where it names something else;
all other nodes are left out of the fit. These names are no features, or the trees would only repeat them:
structure alone gives a node's odds. Where the nearest name speaks for a node, the odds move by `SAID` its
way; where none does, structure decides. The fit uses the nodes of at most about `FIT_PAGES` pages, taken
by a hash of their text; every page is then decoded whole. If the sample has no nodes of one kind there is
nothing to fit, and a node's probability is what its tokens say.

Nulls and edges: null html is an empty page with empty text; text outside any element belongs to the
page's body; unclosed tags, comments and quotes end with the page; rows that repeat give repeated rows. A page is
parsed whole, in one task, whatever its length; an empty table gives an empty result. Only the named columns are
read, so further ones of any name change nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FIT_PAGES = 2000
TREES = 10
DEPTH = 4
#: What a name adds to the log odds of structure, or takes from them.
SAID = 4.0

#: Words that name parts of a page (fixed lists).
MAIN = frozenset("article main content post entry story articlebody".split())
OTHER = frozenset(
    "nav navbar navigation menu header head footer sidebar aside ad ads advert advertisement adverts advertising banner "
    "promo promotion sponsor sponsored cookie cookies consent notice notices comment comments form login share social "
    "related newsletter subscribe breadcrumb breadcrumbs pagination popup modal search widget copyright disqus "
    "recommended select button dialog".split()
)
#: Elements that do not break a line of text (fixed list).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base col embed hr input link meta param source track".split())
#: What an opening tag closes if it is open and innermost, besides a paragraph (fixed lists).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})>|<[!?/][^>]*>|<[a-z][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
N_FEATURES = 14


@dataclass
class Nodes:
    """Nodes of a batch of pages, in page order; a parent stands before its children."""

    page: list = field(default_factory=list)
    parent: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    own: list = field(default_factory=list)
    links: list = field(default_factory=list)
    main: list = field(default_factory=list)
    other: list = field(default_factory=list)
    tag: list = field(default_factory=list)
    blocks: list = field(default_factory=list)  # (node, pieces of text)

    def add(self, page: int, parent: int, tag: str, attributes: str) -> int:
        tokens = [tag]
        if attributes and "=" in attributes:
            for value in _NAMED.findall(attributes):
                tokens += [t.lower() for t in _PARTS.findall(value)]
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.own.append(0)
        self.links.append(0)
        self.main.append(sum(t in MAIN for t in tokens))
        self.other.append(sum(t in OTHER for t in tokens))
        self.tag.append(1 if tag == "p" or tag[:1] == "h" and tag[1:].isdigit() else 2 if tag in ("ul", "ol", "li", "dl", "table", "tr", "td") else 0)
        return len(self.page) - 1


def read_page(nodes: Nodes, page: int, source: str) -> None:
    """Append the nodes and text blocks of one page."""
    root = nodes.add(page, -1, "html", "")
    stack, tags, fresh, linked, at = [root], ["html"], True, False, 0

    def text(run: str) -> None:
        nonlocal fresh
        if "&" in run:
            run = html.unescape(run)
        size = len(run) - run.count(" ")
        if not size:
            if not fresh:
                nodes.blocks[-1][1].append(" ")
            return
        node = stack[-1]
        nodes.own[node] += size
        nodes.links[node] += size * linked
        if fresh:
            nodes.blocks.append((node, []))
            fresh = False
        nodes.blocks[-1][1].append(run)

    for token in _TOKEN.finditer(source):
        if token.start() > at:
            text(source[at : token.start()])
        at = token.end()
        name = token.group(3)
        if name is None:
            continue
        name, closing = name.lower(), token.group(2)
        if name in INLINE:
            if name == "a":
                linked = not closing
            elif name == "br" and not fresh:
                nodes.blocks[-1][1].append(" ")
            continue
        fresh = True
        if closing:
            if name in tags[1:]:
                while tags.pop() != name:
                    stack.pop()
                stack.pop()
                linked = False
            continue
        if name in VOID or name == "html":
            continue
        while tags[-1] == "p" or tags[-1] in CLOSES.get(name, ()):
            tags.pop()
            stack.pop()
        stack.append(nodes.add(page, stack[-1], name, token.group(4)))
        tags.append(name)
    if at < len(source):
        text(source[at:])


def read_pages(sources: list[str]) -> Nodes:
    nodes = Nodes()
    for page, source in enumerate(sources):
        read_page(nodes, page, source)
    return nodes


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def _subtree(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    total = values.astype(float).copy()
    for level in reversed(levels[1:]):
        np.add.at(total, parent[level], total[level])
    return total


def features(nodes: Nodes) -> np.ndarray:
    parent, depth = np.array(nodes.parent), np.array(nodes.depth)
    own, links = np.array(nodes.own, float), np.array(nodes.links, float)
    levels, n = _levels(depth), len(parent)
    up = np.maximum(parent, 0)
    chars, linked = _subtree(own, parent, levels), _subtree(links, parent, levels)
    count = _subtree(np.ones(n), parent, levels)
    child = np.flatnonzero(parent >= 0)
    children = np.bincount(parent[child], minlength=n)
    among = np.zeros(n)
    order = child[np.argsort(parent[child], kind="stable")]
    if len(order):
        first = np.r_[True, np.diff(parent[order]) != 0]
        among[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    # Wrappers around all there is are no depth: only ancestors with several children count.
    branch = np.zeros(n)
    page_chars = chars.copy()
    for level in levels[1:]:
        page_chars[level] = page_chars[parent[level]]
        branch[level] = branch[parent[level]] + (children[parent[level]] > 1)
    density = chars / count
    siblings = np.where(parent >= 0, children[up], 1)
    tag = np.array(nodes.tag)
    columns = [
        branch, np.log1p(own), np.log1p(chars), np.log1p(count), density, linked / np.maximum(chars, 1), children, siblings,
        among, among / np.maximum(siblings, 1), chars / np.maximum(page_chars, 1), density[up],
        np.log1p(chars[up] / np.maximum(siblings, 1)), tag,
    ]
    return np.column_stack(columns).astype(float)


def weak_labels(nodes: Nodes) -> np.ndarray:
    """1 and 0 where the nearest token on the path names a part of the page, -1 elsewhere. Tokens of both
    kinds on one node say nothing. A token of another part says nothing, for what is below neither, on a
    wrapper (a body 'with-sidebar'): a node that has main content inside, or most of the text of a page that
    names no main content."""
    parent = np.array(nodes.parent)
    levels = _levels(np.array(nodes.depth))
    main, other = np.array(nodes.main) > 0, np.array(nodes.other) > 0
    inside, chars = _subtree(main & ~other, parent, levels), _subtree(np.array(nodes.own), parent, levels)
    page = np.maximum.accumulate(np.where(parent < 0, np.arange(len(parent)), 0))  # the root of each node
    wraps = other & ~main & ((inside > 0) | ((inside[page] == 0) & (2 * chars > chars[page])))
    said = np.where(main == other, -1, np.where(main, 1, 0))
    said[wraps] = -1
    for level in levels[1:]:
        silent = level[(said[level] < 0) & ~wraps[level]]
        said[silent] = said[parent[silent]]
    return said


def decode(nodes: Nodes, p: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which every kept node's parent is kept."""
    parent = np.array(nodes.parent)
    levels = _levels(np.array(nodes.depth))
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), _subtree(np.log1p(-p), parent, levels)
    for level in reversed(levels[1:]):
        np.add.at(keep, parent[level], np.maximum(keep, drop)[level])
    kept = np.ones(len(p), bool)
    for level in levels[1:]:
        kept[level] = kept[parent[level]] & (keep[level] > drop[level])
    return kept


@dataclass
class Trees:
    """A fitted ensemble as arrays: per tree and node the feature (-1 at a leaf), threshold, children, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    def probability(self, x: np.ndarray, said: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.weight)):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = self.feature[t][at]
                below = x[rows, np.maximum(f, 0)] <= self.threshold[t][at]
                at = np.where(f < 0, at, np.where(below, self.left[t][at], self.right[t][at]))
            margin += self.weight[t] * self.value[t][at]
        return 1 / (1 + np.exp(-2 * margin - np.where(said < 0, 0, np.where(said > 0, SAID, -SAID))))


def _as_arrays(model) -> Trees:
    """The trees of a fitted model, a few hundred nodes."""
    parts = []
    for tree in model.trees:
        rows: list[list] = []

        def walk(node, rows=rows) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        parts.append(rows)
    size = max(map(len, parts))
    table = np.array([rows + [[-1, 0.0, 0, 0, 0.0]] * (size - len(rows)) for rows in parts])
    pick = lambda i, kind: np.ascontiguousarray(table[:, :, i].astype(kind))
    return Trees(pick(0, int), pick(1, float), pick(2, int), pick(3, int), pick(4, float), np.array(model.treeWeights))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = read_pages([h or "" for h in batch["html"].to_pylist()])
        x, y = (features(nodes), weak_labels(nodes)) if len(batch) else (np.zeros((0, N_FEATURES)), np.zeros(0))
        x, y = x[y >= 0], y[y >= 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(y.astype(float)), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"]
        )


def fit(pages: DataFrame, html_col: str, most_pages: int = FIT_PAGES) -> Trees | None:
    """Fit the trees on the weakly labelled nodes of about `most_pages` pages; None without both kinds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    total = pages.count()
    share = min(1.0, most_pages / max(total, 1))
    source = pages.select(F.col(html_col).alias("html"))
    drawn = F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    # The share is of all pages; equal pages are drawn together, so the limit holds whatever repeats.
    sample = source.filter(drawn).limit(2 * most_pages).mapInArrow(_labelled, "label double, x array<double>")
    rows = sample.select("label", array_to_vector("x").alias("features")).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False, checkpointInterval=-1).fit(rows)
        return _as_arrays(model)
    finally:
        rows.unpersist()


def main_texts(sources: list[str], trees: Trees | None) -> list[str]:
    nodes = read_pages(sources)
    if not sources:
        return []
    x = features(nodes)
    said = weak_labels(nodes)
    p = trees.probability(x, said) if trees is not None else np.where(said < 0, 0.5, said)
    kept = decode(nodes, p)
    out: list[list[str]] = [[] for _ in sources]
    for node, pieces in nodes.blocks:
        if kept[node]:
            line = " ".join("".join(pieces).split())
            if line:
                out[nodes.page[node]].append(line)
    return ["\n".join(lines) for lines in out]


def _extract(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = main_texts([h or "" for h in part["html"].to_pylist()], trees)
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if there is none) and n_chars."""
    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_col).alias("html"))
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    trees = fit(plain, "html")
    return plain.mapInArrow(
        _extract(trees), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
