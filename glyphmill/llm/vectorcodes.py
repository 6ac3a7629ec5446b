"""Product quantisation in exact integers: a codebook for each part position, nearest entries by kd-tree.

A component x becomes the integer floor(scale * x). A vector is cut into equal consecutive parts; each position's codebook
starts as the parts of the rows with the smallest ids. In each round the codebooks' kd-trees are broadcast (their size is
parts x entries x part width, whatever the data), every task assigns its rows and sums them by entry, and Spark adds up the
tasks' sums, which are the only thing that the driver sees. Rows are read where they are and never shuffled.

A tree's search is branch-and-bound over boxes, for all rows of a batch together: rows enter a node only while the box's
distance is at most their best one. Boxes at the same distance are entered too, so of entries at equal distance the lowest
index wins. Squares are summed in 64-bit integers where these can't overflow, else in Python's; sums over rows are kept in
limbs of 20 bits, so no number of rows overflows.

Left out: rows whose vector is null or holds null or non-finite components. Lengths that aren't a multiple of the number of
parts are filled up with zeros, which change no distance. Each length of vectors has codebooks of its own. Rows with a null
id are coded, but start no codebook unless fewer than `entries` rows have an id; repeated rows count as often as they occur.
With fewer rows than entries a codebook has as many entries as rows. An error beyond a long is null, as is the sum of its
label. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_LEAF, _LIMB = 2, 20
_LONG = 1 << 63


def finite(vec: Column) -> Column:
    """The vector is there and all its components are finite."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where one doesn't fit."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not len(y.ravel()) or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def by_length(vec: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer matrix) of a column of vectors, for each length in it."""
    stop = np.cumsum(np.array([0, *vec.value_lengths().to_pylist()], np.int64))
    flat, size = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(stop)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield n, rows, floors(flat[stop[rows][:, None] + np.arange(n)], scale)


def split(m: np.ndarray, parts: int) -> np.ndarray:
    """[parts, rows, width]"""
    width = -(-m.shape[1] // parts)
    full = np.zeros((len(m), parts * width), m.dtype)
    full[:, : m.shape[1]] = m
    return full.reshape(len(m), parts, width).transpose(1, 0, 2)


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    own: list[int]
    sides: tuple[Node, Node] | None = None


class KdTree:
    """The entries of a codebook. Every node has the box of its entries and is cut at the median of its widest axis."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._grow(list(range(len(entries))))

    def _grow(self, own: list[int]) -> Node:
        held = self.entries[own]
        low, high = held.min(axis=0), held.max(axis=0)
        if len(own) <= _LEAF or not (low < high).any():
            return Node(low, high, own)
        axis = int(np.argmax(high - low))
        order = sorted(own, key=lambda i: (self.entries[i, axis], i))
        half = len(order) // 2
        return Node(low, high, own, (self._grow(order[:half]), self._grow(order[half:])))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry to each row of x, the lowest of equally near ones, and its squared distance."""
        entries, x = self._safe(x)
        big = np.iinfo(np.int64).max if x.dtype == np.int64 else 1 << 4400
        best, found = np.full(len(x), big, x.dtype), np.full(len(x), len(entries))

        def apart(node: Node, rows: np.ndarray) -> np.ndarray:
            q = x[rows]
            gap = np.maximum(np.maximum(node.low.astype(x.dtype) - q, q - node.high.astype(x.dtype)), 0)
            return (gap * gap).sum(axis=1)

        def visit(node: Node, rows: np.ndarray) -> None:
            if node.sides is None:
                for e in node.own:
                    gap = x[rows] - entries[e]
                    far = (gap * gap).sum(axis=1)
                    ok = (far < best[rows]) | ((far == best[rows]) & (e < found[rows]))
                    best[rows[ok]], found[rows[ok]] = far[ok], e
                return
            away = [apart(side, rows) for side in node.sides]
            first = away[0] <= away[1]
            for mine, order in ((first, (0, 1)), (~first, (1, 0))):
                for k in order:
                    own = rows[mine]
                    own = own[away[k][mine] <= best[own]]
                    if len(own):
                        visit(node.sides[k], own)

        if len(x):
            visit(self.root, np.arange(len(x)))
        return found, best

    def _safe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and rows in 64-bit integers if no sum of squares over PARTS parts can reach 2**62, else in Python's."""
        most = max((max(abs(int(m.min())), abs(int(m.max()))) for m in (self.entries, x) if m.size), default=0)
        kind = np.int64 if 256 * max(x.shape[1], 1) * (2 * most) ** 2 < 1 << 62 else object
        return self.entries.astype(kind), x.astype(kind)


@dataclass
class Codebooks:
    """trees[length]: the codebooks of vectors of that length, one for each part position."""

    trees: dict[int, list[KdTree]]
    scale: int

    def sha256(self, length: int) -> str:
        """Of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for t in self.trees[length] for e in t.entries.tolist() for v in e).encode()).hexdigest()


def _first(vectors: DataFrame, id_col: str, vec_col: str, parts: int, entries: int, scale: int) -> dict[int, list[np.ndarray]]:
    """Codebooks of the rows with the smallest ids; Spark keeps `entries` rows a length in each task before it sorts them."""
    place = W.partitionBy(F.size("vec")).orderBy(F.col("id").asc_nulls_last(), "vec")
    few = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).withColumn("at", F.row_number().over(place)).where(F.col("at") <= entries)
    held: dict[int, list] = {}
    for r in sorted(few.collect(), key=lambda r: r["at"]):
        held.setdefault(len(r["vec"]), []).append(r["vec"])
    return {n: list(split(floors(np.array(rows, np.float64).reshape(len(rows), n), scale), parts)) for n, rows in sorted(held.items())}


def learn_codebooks(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after `rounds` rounds of assignment and of means rounded down; entries that no part is nearest to stay."""
    if not 1 <= entries <= 256 or parts < 1 or scale < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, at least one part, a scale of at least 1 and no fewer than 0 rounds are possible")
    spark = vectors.sparkSession
    usable = vectors.select(id_col, vec_col).where(finite(F.col(vec_col)))
    books = _first(usable, id_col, vec_col, parts, entries, scale)
    only = usable.select(F.col(vec_col).cast("array<double>").alias("vec"))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast({n: [KdTree(b) for b in own] for n, own in books.items()})

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, int] = {}
            for batch in batches:
                for n, _, m in by_length(batch.column(0), scale):
                    for p, (tree, x) in enumerate(zip(shared.value[n], split(m, parts), strict=True)):
                        hot = (tree.nearest(x)[0][:, None] == np.arange(len(tree.entries))).astype(np.float64)
                        own = [(-1, 0, hot.sum(axis=0)[:, None])]
                        for limb, low in limbs(x):
                            own.append((0, limb, hot.T @ low))
                        for start, limb, value in own:
                            for (e, k), s in np.ndenumerate(value):
                                if s:
                                    key = (n, p, e, start + k, limb)
                                    total[key] = total.get(key, 0) + int(s)
            keys = [pa.array([k[i] for k in total], pa.int32()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(list(total.values()), pa.int64())], names=["size", "part", "entry", "at", "limb", "s"])

        found = only.mapInArrow(sums, "size int, part int, entry int, at int, limb int, s long").groupBy("size", "part", "entry", "at", "limb").agg(F.sum("s").alias("s"))
        added: dict[tuple, int] = {}
        for size, part, entry, at, limb, s in found.collect():
            added[size, part, entry, at] = added.get((size, part, entry, at), 0) + (s << (_LIMB * limb))
        for n, own in books.items():
            for p, book in enumerate(own):
                new = [[added.get((n, p, e, k), 0) // count if (count := added.get((n, p, e, -1))) else book[e, k] for k in range(book.shape[1])] for e in range(len(book))]
                small = all(abs(int(v)) < 1 << 62 for row in new for v in row)
                own[p] = np.array(new, np.int64 if small else object).reshape(book.shape)
        shared.destroy()
    return Codebooks({n: [KdTree(b) for b in own] for n, own in books.items()}, scale)


def limbs(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """x as digits to the base 2**20, lowest first, as floats; the last digit has the sign."""
    at = 0
    while x.size:
        if max(abs(int(x.min())), abs(int(x.max()))) < 1 << _LIMB:
            yield at, x.astype(np.float64)
            return
        yield at, (x & ((1 << _LIMB) - 1)).astype(np.float64)
        x, at = x >> _LIMB, at + 1


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Per usable row: id_col and `keep`, size (the vector's length), code (two hex digits a part), error (squared distance to the code, null beyond a long)."""
    cols = list(dict.fromkeys([id_col, *(keep or [])]))
    if clash := {"size", "code", "error", "vec"} & set(cols):
        raise ValueError(f"columns {sorted(clash)} of the input have names of the result")
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    fields = [vectors.schema[c] for c in cols]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            size, code, error = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, object)
            for n, rows, m in by_length(batch.column("vec"), own.scale):
                near = [tree.nearest(x) for tree, x in zip(own.trees[n], split(m, len(own.trees[n])), strict=True)]
                digits = np.stack([i for i, _ in near], axis=1).astype(np.uint8)
                size[rows], code[rows] = n, [d.tobytes().hex() for d in digits]
                error[rows] = sum(d.astype(object) for _, d in near)
            error = [int(e) if e < _LONG else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(size), pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())], names=[*cols, "size", "code", "error"])

    rows = vectors.where(finite(F.col(vec_col))).select(*cols, F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(kernel, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "size int, code string, error long"]))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per usable row: id_col, code, error, label_error (errors summed over the label, null labels together), codebooks_sha256."""
    books = learn_codebooks(vectors, id_col, vec_col, parts, entries, rounds, scale)
    coded = cut(encode(vectors.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v"), F.col(label_col).alias("l")), books, "i", "v", ["l"]))
    # one row a label; a sum that misses an error or passes a long is null
    of = coded.groupBy("l").agg(F.when(F.count("*") == F.count("error"), F.expr("try_sum(error)")).alias("label_error"))
    sha = F.lit(None).cast("string")
    for n in books.trees:
        sha = F.when(F.col("size") == n, F.lit(books.sha256(n))).otherwise(sha)
    out = coded.alias("c").join(of.alias("o"), F.col("c.l").eqNullSafe(F.col("o.l")), "left")
    return out.select(F.col("i").alias(id_col), "code", "error", "label_error", sha.alias("codebooks_sha256"))
