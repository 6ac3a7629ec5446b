"""Embedding near-duplicates by cosine within a label: PCA-ordered tiled comparison.

Equal vectors of a label collapse first, so copies are never compared. Unit vectors are rotated to the principal axes of all
of them (one 64 x 64 sum a task goes to the driver), which puts most of a dot product into its leading terms. Cells of width
sqrt(2 - 2t) in the first CELL_DIMS axes hold every pair with cosine >= t in the same or in touching cells; a cell beyond
TILE vectors is dealt into several tiles by hash. A task compares two tiles: it adds up leading dimensions in steps, and
after each step bounds the rest of each product by the product of the suffix norms; pairs whose bound is below the
threshold are dropped, and a tile pair stops when none is left. Pairs that stay are computed again, in double precision
from the original components. Tasks yield counts per vector and a spanning forest, never all pairs.

Vectors that are null, empty, zero, hold null or non-finite components, or have a null label link with nothing. Rows with
a null id have no component of their own and are never the smallest. Equal rows link with one another. Vectors of different
lengths don't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import components, cut

COSINE, TILE, CELL_DIMS, STEP = 0.98, 1024, 3, 16
_SLACK = 1e-9


def usable(vec: Column, label: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no cosine: squares of tiny or huge components stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Rotation [dim, dim] whose columns are the eigenvectors of the unit vectors' second moments, largest first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(0)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["m"])

    parts = classes.where(F.size("vec") == dim).select("vec").mapInArrow(kernel, "m array<double>").select(F.posexplode("m").alias("at", "x"))
    flat = np.array([r[1] for r in parts.groupBy("at").agg(F.sum("x")).orderBy("at").collect()])
    return np.linalg.eigh(flat.reshape(dim, dim))[1][:, ::-1] if len(flat) else np.eye(dim)


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with cosine >= threshold (i < j if both are the same tile)."""
    a, b = _scaled(a), _scaled(b)
    ua, ub = _unit(a), _unit(b)
    pa_, pb = ua @ axes, ub @ axes
    rest_a, rest_b = ((np.sqrt(np.maximum(1 - np.cumsum(p * p, axis=1), 0))) for p in (pa_, pb))
    dot = pa_[:, :STEP] @ pb[:, :STEP].T
    end = min(STEP, a.shape[1]) - 1
    keep = dot + np.outer(rest_a[:, end], rest_b[:, end]) >= threshold - _SLACK
    if same:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    dot = dot[i, j]
    for lo in range(STEP, a.shape[1], STEP):
        if not len(i):
            break
        hi = min(lo + STEP, a.shape[1])
        dot = dot + np.einsum("ij,ij->i", pa_[i, lo:hi], pb[j, lo:hi])
        ok = dot + rest_a[i, hi - 1] * rest_b[j, hi - 1] >= threshold - _SLACK
        i, j, dot = i[ok], j[ok], dot[ok]
    # in double precision, in the original components
    norm = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b)]
    sure = np.empty(len(i), bool)
    for lo in range(0, len(i), 100_000):
        s = slice(lo, lo + 100_000)
        sure[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) / (norm[0][i[s]] * norm[1][j[s]]) >= threshold
    return i[sure], j[sure]


def _tile_links(axes: np.ndarray, threshold: float):
    def solve(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        side, cls = t.column("side").to_numpy(), t.column("cls").to_numpy()
        many, vec = t.column("many").to_numpy(), _matrix(t.column("vec").combine_chunks())
        same = not (side == 1).any()
        own = np.flatnonzero(side == 0)
        other = own if same else np.flatnonzero(side == 1)
        if not len(own) or not len(other):
            return np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        i, j = compare_tiles(vec[own], vec[other], axes, threshold, same)
        i, j = own[i], other[j]
        links = np.zeros(len(cls), np.int64)
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        # every link's larger end hangs on the smallest class it links with here; what that leaves apart is linked too
        root = np.arange(len(cls))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        forest = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                forest.append((cls[x], cls[y]))
        at = np.flatnonzero(links)
        return np.stack([cls[at], links[at]]), np.array(forest, np.int64).reshape(-1, 2).T

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            count, forest = solve(t)
            none = pa.nulls(count.shape[1], pa.int64())
            if count.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(count[0]), none, pa.array(count[1])], names=["x", "y", "n"])
            if forest.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(forest[0]), pa.array(forest[1]), pa.nulls(forest.shape[1], pa.int64())], names=["x", "y", "n"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            pair = held.column("pair").to_numpy()
            if not len(pair):
                continue
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield from out(held.slice(lo, hi - lo))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from out(held)

    return kernel


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = COSINE, tile: int = TILE) -> DataFrame:
    """Per row: id_col, n_links (other rows linked directly), component_id (smallest id reachable), kept. Ids are integers."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    kind = vectors.schema[id_col].dataType
    source = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    source = source.withColumn("ok", usable(F.col("vec"), F.col("label"))).withColumn("key", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "vec")), 256)))
    good = source.where("ok")
    # one row for equal vectors of a label; cls is a number of its own, so that null ids don't matter
    classes = cut(good.groupBy("key").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("vec").alias("vec")).withColumn("cls", F.monotonically_increasing_id()))
    found = None
    width = float(np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6)
    for dim in sorted(r[0] for r in classes.select(F.size("vec")).distinct().collect()):
        links = _links(classes.where(F.size("vec") == dim), principal_axes(classes, dim), dim, width, threshold, tile)
        found = links if found is None else found.union(links)
    empty = vectors.sparkSession.createDataFrame([], "x long, y long, n long")
    found = cut(found) if found is not None else empty
    counts = found.where("n is not null").groupBy(F.col("x").alias("cls")).agg(F.sum("n").alias("n"))
    group = components(found.where("n is null").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "cls")
    member = classes.select("cls", "key", "many", "rep").join(counts, "cls", "left").join(group, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    member = cut(member)
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = member.join(least, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("links"), "component_id")
    out = source.select("id", "key").join(member, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col).cast(kind) == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, axes: np.ndarray, dim: int, width: float, threshold: float, tile: int) -> DataFrame:
    """(x, y, n): n links of class x (y null), or a link of the spanning forest (n null)."""
    lead = min(CELL_DIMS, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(_unit(_matrix(batch.column(1))) @ axes[:, :lead] / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.tolist(), pa.list_(pa.int32()))], names=["cls", "cell"])

    cells = cut(classes.select("cls", "vec").mapInArrow(place, "cls long, cell array<int>").join(classes.select("cls", "label"), "cls"))
    sizes = cells.groupBy("label", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiled = cells.join(sizes, ["label", "cell"]).select("cls", "label", "cell", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int").alias("tile"))
    tiles = sizes.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    # tile pairs: a cell and its neighbours, each pair once
    moves = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = tiles.withColumn("other", F.array().cast("array<int>"))
    for k in range(lead):
        near = near.withColumn("m", F.explode(moves)).withColumn("other", F.concat("other", F.array(F.col("cell")[k] + F.col("m")))).drop("m")
    b = tiles.select("label", F.col("cell").alias("other"), F.col("tile").alias("other_tile"))
    pairs = near.join(b, ["label", "other"]).where("struct(cell, tile) <= struct(other, other_tile)")
    pairs = cut(pairs.withColumn("pair", F.monotonically_increasing_id()))
    first = pairs.select("pair", "label", "cell", "tile", F.lit(0).alias("side"))
    second = pairs.where("struct(cell, tile) <> struct(other, other_tile)").select("pair", "label", F.col("other").alias("cell"), F.col("other_tile").alias("tile"), F.lit(1).alias("side"))
    rows = tiled.join(classes.select("cls", "vec", "many"), "cls").join(first.union(second), ["label", "cell", "tile"]).select("pair", "side", "cls", "many", "vec")
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_tile_links(axes, threshold), "x long, y long, n long")
