"""Main text of html pages: a conditional random field on the page's tree, with exact sum-product inference.

Nodes are elements and text leaves, each main (an element: holds main text) or not. A node's potential is a sum of learned
weights of its features (names, link density, amounts of text, place in the page); parent-child potentials tie a node to its
parent, one 2 x 2 table for each kind of child. Messages pass from the leaves to the root and back, which gives every node's
exact marginal; all pages of a piece of a batch are passed together, level by level. Leaves with a marginal of 0.5 or more
are main text.

Weights are learned by gradient ascent on the likelihood of labelled pages, whose gradient needs the same marginals. These
pages are LAYOUTS invented ones (`htmllayouts`), and SILVER of the input at most, by hash of the id, that name their article
and their furniture by elements (up to MOST_CHARS characters each); tasks parse them and only feature numbers reach the
driver. Pages are then extracted where they are, without a shuffle.

A null or empty page, and one without text, has an empty text. Repeated rows and ids are fine, each row has its result. White
space is what Python's str.split takes for it; forms' fields, buttons, scripts, styles and titles of documents are never text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .htmllayouts import layout
from .htmltree import BITS, KINDS, Page, encode, landmarks, marks
from .runtime import small_batches

LAYOUTS, SILVER, MOST_CHARS = 1500, 300, 100_000
STEPS, RATE, DECAY = 110, 0.15, 0.3
#: Characters of html that are parsed before their trees are passed.
_PIECE = 2_000_000


@dataclass
class Forest:
    """The trees of many pages: parent (-1: a root), kind and level of each node, features as (node, place) pairs."""

    parent: np.ndarray
    kind: np.ndarray
    node: np.ndarray
    place: np.ndarray

    def __post_init__(self) -> None:
        level = np.zeros(len(self.parent), np.int64)
        at = self.parent.copy()
        while (deeper := at >= 0).any():
            level[deeper] += 1
            at[deeper] = self.parent[at[deeper]]
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(level))[:-1]) if len(level) else []

    @classmethod
    def of(cls, trees: list[tuple[list[int], list[int], list[list[int]]]]) -> Forest:
        base = np.cumsum([0, *(len(t[0]) for t in trees)])
        parent = np.concatenate([np.zeros(0, np.int64), *(np.where(np.array(t[0]) < 0, -1, np.array(t[0]) + b) for t, b in zip(trees, base, strict=False))]).astype(np.int64)
        kind = np.array([k for t in trees for k in t[1]], np.int64)
        many = np.array([len(f) for t in trees for f in t[2]], np.int64)
        return cls(parent, kind, np.repeat(np.arange(len(many)), many), np.array([p for t in trees for f in t[2] for p in f], np.int64))


def marginals(forest: Forest, own: np.ndarray, edge: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """p[node]: the chance of being main; with `pairs`, pair[node, parent's state, own state] (zero for roots).

    own: log potential of each node's state main, that of the other being 0; edge[kind, parent's state, own state]. Messages are
    log odds, so one number a node goes up and one down.
    """
    n = len(own)
    e = edge[forest.kind].transpose(1, 2, 0)
    belief, up, full = own.astype(np.float64), np.zeros(n), np.zeros(n)
    for at in reversed(forest.levels[1:]):
        b = belief[at]
        up[at] = np.logaddexp(e[1, 0, at], e[1, 1, at] + b) - np.logaddexp(e[0, 0, at], e[0, 1, at] + b)
        belief += np.bincount(forest.parent[at], up[at], n)
    full[:] = belief
    above = np.zeros(n)
    for at in forest.levels[1:]:
        a = above[at] = full[forest.parent[at]] - up[at]
        full[at] += np.logaddexp(e[0, 1, at], e[1, 1, at] + a) - np.logaddexp(e[0, 0, at], e[1, 0, at] + a)
    pair = np.zeros((n, 2, 2))
    if pairs and len(forest.levels) > 1:
        at = np.concatenate(forest.levels[1:])
        logs = np.stack([e[0, 0, at], e[0, 1, at] + belief[at], e[1, 0, at] + above[at], e[1, 1, at] + above[at] + belief[at]], axis=1)
        both = np.exp(logs - logs.max(axis=1, keepdims=True))
        pair[at] = (both / both.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
    return 1 / (1 + np.exp(-np.clip(full, -700, 700))), pair


@dataclass
class TreeModel:
    weight: np.ndarray
    edge: np.ndarray

    def score(self, forest: Forest) -> np.ndarray:
        """Each node's marginal of being main."""
        own = np.bincount(forest.node, self.weight[forest.place], len(forest.parent))
        return marginals(forest, own, self.edge)[0]


def train(forest: Forest, label: np.ndarray) -> TreeModel:
    """Maximise the log likelihood of the labels less DECAY / 2 times the squared weights, by Adam over all pages at once."""
    used, place = np.unique(forest.place, return_inverse=True)
    n, child = len(label), np.flatnonzero(forest.parent >= 0)
    theta, edge = np.zeros(len(used)), np.zeros((KINDS, 2, 2))
    cell = (forest.kind[child] * 4 + label[forest.parent[child]] * 2 + label[child]).astype(np.int64)
    seen = np.bincount(cell, minlength=KINDS * 4).reshape(KINDS, 2, 2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, edge)]
    for step in range(1, STEPS + 1):
        p, pair = marginals(forest, np.bincount(forest.node, theta[place], n), edge, pairs=True)
        wanted = np.stack([np.bincount(forest.kind[child], pair[child, a, b], KINDS) for a in (0, 1) for b in (0, 1)], axis=1).reshape(KINDS, 2, 2)
        slopes = [np.bincount(place, (label - p)[forest.node], len(used)) - DECAY * theta, seen - wanted - DECAY * edge]
        for x, g, m in zip((theta, edge), slopes, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += RATE * (1 - step / (STEPS + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-3)
    weight = np.zeros(1 << BITS)
    weight[used] = theta
    return TreeModel(weight, edge)


_TREE = "place long, parent array<int>, kind array<int>, many array<int>, features array<int>, label array<int>"


def _row(at: int, tree: tuple, label: list[int]) -> tuple:
    return at, tree[0], tree[1], [len(f) for f in tree[2]], [p for f in tree[2] for p in f], label


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.list_(pa.int32())] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["place", "parent", "kind", "many", "features", "label"])


def labelled(pages: DataFrame, id_col: str, html_col: str, layouts: int = LAYOUTS, silver: int = SILVER) -> DataFrame:
    """Trees of the labelled pages."""
    spark = pages.sparkSession

    def invented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [(i, Page(layout(i))) for i in batch.column(0).to_pylist()]
            yield _rows([_row(i, encode(p), marks(p)) for i, p in parsed])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                if (label := landmarks(page)) is not None:
                    found.append(_row(at, encode(page), label))
            yield _rows(found)

    order = F.xxhash64(F.col(id_col).cast("string"), "html")
    tells = F.lower("html").rlike("<(article|main)[\\s>]") & (F.length("html") <= MOST_CHARS)
    few = pages.select(F.col(id_col), F.col(html_col).alias("html")).where(tells).select(order.alias("place"), "html").orderBy("place", "html").limit(silver)
    return spark.range(0, layouts, 1, 8).mapInArrow(invented, _TREE).union(few.mapInArrow(named, _TREE))


def learn_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", layouts: int = LAYOUTS, silver: int = SILVER) -> TreeModel:
    """The model of the labelled pages; the pages' order, not that of tasks, decides the sums."""
    small_batches(pages.sparkSession)
    rows = sorted(labelled(pages, id_col, html_col, layouts, silver).toArrow().to_pylist(), key=lambda r: (r["place"], r["features"]))
    trees, label = [], []
    for r in rows:
        stop = np.cumsum([0, *r["many"]]).tolist()
        trees.append((r["parent"], r["kind"], [r["features"][a:b] for a, b in zip(stop[:-1], stop[1:], strict=True)]))
        label += r["label"]
    return train(Forest.of(trees), np.array(label, np.int64))


def main_texts(pages: list[str], model: TreeModel) -> list[str]:
    parsed = [Page(p) for p in pages]
    score = model.score(Forest.of([encode(p) for p in parsed])) >= 0.5
    out, at = [], 0
    for p in parsed:
        elements = 1 + sum(1 for n in p.nodes[1:] if n.words)
        at += elements
        out.append(p.text(score[at : at + len(p.full)].tolist()))
        at += len(p.full)
    return out


def extract_main_text(pages: DataFrame, model: TreeModel, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all other columns) and text."""
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    if "text" in keep:
        raise ValueError("the input has a column named text, as the result")
    shared, names = pages.sparkSession.sparkContext.broadcast(model), [*(f"c{i}" for i in range(len(keep))), "text"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lo, n = 0, batch.num_rows
            while lo < n or not n:
                # pieces of the batch, by the size of their html
                sources, total, hi = [], 0, lo
                while hi < n and (not sources or total < _PIECE):
                    sources.append(batch.column(len(keep))[hi].as_py() or "")
                    total, hi = total + len(sources[-1]), hi + 1
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(main_texts(sources, own), pa.string())], names=names)
                if not n:
                    break
                lo = hi

    fields = [*(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=False)), "text string"]
    rows = pages.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=False)), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(kernel, ", ".join(fields)).toDF(*keep, "text")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id_col, url_col, text, n_chars (code points)."""
    rows = pages.select(id_col, url_col, html_col)
    found = extract_main_text(rows, learn_main_text(rows, id_col, html_col), html_col)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
