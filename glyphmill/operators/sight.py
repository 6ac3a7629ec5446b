"""Sight in plans: rays, isovists, what a cell sees, and the graph of cells that see one another.

A plan is rows (plan_id, x, y, wall), cells from 0; cells not given are wall. Each plan becomes one row with its free cells as flags
(`grids`), as an image is. Coordinates fall into the cell of their whole part; rays advance by half a cell.

Where a ray from a given cell goes doesn't depend on the walls, so the rays of an origin are laid out once for all plans of one size, as
a tree of the cells that they pass: rays that still run through the same cells share its nodes. Spark deals out origins; a task
walks a tree for many origins at once, node by node, in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import checkpoint_dir
from .geometry import line_samples

#: Rays of an isovist and of a mask, their step, and the jump between neighbouring rays that occludes: fixed values.
ISOVIST_RAYS, MASK_RAYS, STEP, JUMP = 720, 1440, 0.5, 3.0
#: Origins that a task looks from at once.
ROWS = 256
#: Cells of a plan, and of its longer side, up to which its graph is a matrix; elements of the matrices that a task holds at once.
SMALL, SIDE, CELLS = 256, 32, 1 << 22


def free_cells(plan: DataFrame) -> DataFrame:
    return plan.where(~F.col("wall")).select("plan_id", "x", "y")


def grids(plan: DataFrame) -> DataFrame:
    """(plan_id, w, h, free): free is an array of flags in row order. A plan's rows meet once."""
    given = plan.where("x >= 0 AND y >= 0").repartition("plan_id").groupBy("plan_id", "y", "x").agg(F.coalesce(F.bool_or(~F.col("wall")), F.lit(False)).alias("open"))
    rows = given.groupBy("plan_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.sort_array(F.collect_list(F.struct("y", "x", "open"))).alias("c"))
    at = lambda c: (c["y"] * F.col("w") + c["x"]).cast("int")
    before = lambda i: F.when(i > 0, at(F.get("c", i - 1))).otherwise(-1)
    # what's missing between two cells, and after the last, is wall
    filled = F.flatten(F.transform("c", lambda c, i: F.concat(F.array_repeat(F.lit(False), at(c) - before(i) - 1), F.array(c["open"]))))
    size = (F.col("w") * F.col("h")).cast("int")
    tail = F.array_repeat(F.lit(False), size - at(F.element_at("c", F.lit(-1))) - 1)
    return rows.select("plan_id", "w", "h", F.when(F.size("c") == size, F.transform("c", lambda c: c["open"])).otherwise(F.concat(filled, tail)).alias("free"))


def _inside(x: Column, y: Column) -> Column:
    return (x >= 0) & (x < F.col("w")) & (y >= 0) & (y < F.col("h"))


def _cell(x: Column, y: Column) -> Column:
    return (F.floor(y) * F.col("w") + F.floor(x)).cast("int")


def line_is_free(dx: Column, dy: Column) -> Column:
    """Whether the samples of the line from (ox, oy), 2 d + 2 of them where its longer side is d, lie in free cells."""
    n = F.greatest(F.abs(dx), F.abs(dy)) * 2 + 1
    wall = lambda i: ~F.get("free", _cell(F.col("ox") + dx * (i / n), F.col("oy") + dy * (i / n)))
    return ~F.exists(F.sequence(F.lit(0), n.cast("int")), wall)


@lru_cache(maxsize=128)
def ray_tree(w: int, h: int, ox: float, oy: float, rays: int, first: int, merge: bool = False) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(levels, leaf): per step from `first` on the parents of its nodes and their cells (w * h outside), and each ray's last node.

    With `merge`, steps that stay in a ray's cell are left out.
    """
    angle = [i * (2 * math.pi / rays) for i in range(rays)]
    c, s = np.array([math.cos(a) for a in angle]), np.array([math.sin(a) for a in angle])
    k = np.arange(first, math.floor(math.hypot(w, h) / STEP) + 1)[:, None] * STEP
    x, y = ox + c * k, oy + s * k
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    cell = np.where(inside, np.floor(y) * w + np.floor(x), w * h).astype("int64")
    if merge and len(cell):
        stay = np.zeros(cell.shape, bool)
        stay[1:] = cell[1:] == cell[:-1]
        cell = np.take_along_axis(np.where(stay, w * h, cell), np.argsort(stay, 0, kind="stable"), 0)
    levels, node = [], np.zeros(rays, "int64")
    for row in cell:
        if (row == w * h).all() and merge:
            break
        made, node = np.unique(node * (w * h + 1) + row, return_inverse=True)
        levels.append((made // (w * h + 1), made % (w * h + 1)))
    return levels, node


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple, np.ndarray]]:
    """Rows (w, h, ox, oy, free) of one size and origin, some hundreds at most: their numbers, (w, h, ox, oy), and flags [cell, row], a last cell being false."""
    key = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("w", "h", "ox", "oy")])
    starts, flags = batch.column("free").offsets.to_numpy(), batch.column("free").values.to_numpy(zero_copy_only=False)
    order = np.lexsort(key)
    ends = np.flatnonzero((np.diff(key[:, order]) != 0).any(0)) + 1
    for group in np.split(order, ends) if len(order) else []:
        w, h, ox, oy = key[:, group[0]].tolist()
        size = int(w * h)
        for rows in np.array_split(group, -(-len(group) // ROWS)):
            free = np.zeros((size + 1, len(rows)), bool)
            free[:size] = flags[starts[rows] + np.arange(size)[:, None]]
            yield rows, (int(w), int(h), ox, oy), free


def _measured(batch: pa.RecordBatch, rays: int, jump: float) -> list[np.ndarray]:
    """Per row: twice the area of the triangles over the sine, perimeter, occlusivity, least and greatest ray, mean, second and third central moments, mean end (x, y), closed."""
    out = np.zeros((10, batch.num_rows))
    closed = np.zeros(batch.num_rows, bool)
    apart = math.cos(2 * math.pi / rays)
    angle = [i * (2 * math.pi / rays) for i in range(rays)]
    turn = np.array([[math.cos(a) for a in angle], [math.sin(a) for a in angle]])
    for rows, (w, h, ox, oy), free in _alike(batch):
        levels, leaf = ray_tree(w, h, ox, oy, rays, 1)
        n, last = len(rows), len(levels)
        alive, steps, left = np.ones((1, n), bool), np.zeros((1, n), "int32"), np.zeros((1, n), bool)
        for parent, cell in levels:
            # a ray that ends here outside has left the plan
            before = alive[parent]
            alive = before & free[cell]
            steps, left = steps[parent] + alive, left[parent]
            left[cell == w * h] |= before[cell == w * h]
        if not levels:
            leaf = np.zeros(rows.size and rays, "int64")
        k, solid = steps[leaf] + 1, ~(left | (steps == last))[leaf]
        k2, both = np.roll(k, -1, 0), solid & np.roll(solid, -1, 0)
        r = np.arange(last + 2) * STEP
        side = np.sqrt(np.maximum(r[:, None] * r[:, None] + r * r - 2 * r[:, None] * r * apart, 0))
        length = side.ravel()[k * (last + 2) + k2]
        hidden = np.where((np.abs(k - k2) * STEP > jump) | ~both, length, 0.0)
        v = k * STEP
        mean = v.sum(0) / rays
        off = v - mean
        square = off * off
        out[:, rows] = [(v * (k2 * STEP)).sum(0), length.sum(0), hidden.sum(0), v.min(0), v.max(0), mean, square.sum(0) / rays, (square * off).sum(0) / rays, *(turn @ v / rays)]
        closed[rows] = solid.all(0)
    return [*out, closed]


def _looked(batch: pa.RecordBatch, rays: int) -> pa.Array:
    """Per row flags of the cells that rays from its origin pass, the origin's own among them; none for an origin outside."""
    kept = batch.column("free")
    seen, starts = np.zeros(len(kept.values), bool), kept.offsets.to_numpy()
    for rows, (w, h, ox, oy), free in _alike(batch):
        if not (0 <= ox < w and 0 <= oy < h):
            continue
        alive, found = np.ones((1, len(rows)), bool), np.zeros_like(free)
        for parent, cell in ray_tree(w, h, ox, oy, rays, 0, True)[0]:
            alive = alive[parent] & free[cell]
            by = np.argsort(cell, kind="stable")
            at, first = np.unique(cell[by], return_index=True)
            found[at] |= np.logical_or.reduceat(alive[by], first, axis=0)
        found[math.floor(oy) * w + math.floor(ox)] = True
        seen[starts[rows] + np.arange(w * h)[:, None]] = found[:-1]
    return pa.ListArray.from_arrays(kept.offsets, pa.array(seen))


def _over(df: DataFrame, keep: list[str], more: str, f: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df's columns `keep` and those that f makes of each Arrow batch."""
    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(more).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(v if isinstance(v, pa.Array) else pa.array(v) for v in f(b))], names=schema.names)

    return df.mapInArrow(run, schema)


def _spread(o: DataFrame) -> DataFrame:
    """Origins over all tasks: they are few bytes and much work, which partitions sized by bytes would leave to one task."""
    return o.repartition(int(o.sparkSession.conf.get("spark.sql.shuffle.partitions")), "plan_id", "ox", "oy")


def looks(origins: DataFrame, plan: DataFrame, rays: int = MASK_RAYS) -> DataFrame:
    """origins: plan_id, ox, oy. (plan_id, ox, oy, w, free, seen): flags of the cells that are free and of those that rays pass before they meet a wall or leave the plan."""
    o = _spread(origins.select("plan_id", "ox", "oy").join(grids(plan), "plan_id"))
    return _over(o.select("plan_id", "ox", "oy", "w", "h", "free"), ["plan_id", "ox", "oy", "w", "free"], "seen array<boolean>", lambda b: [_looked(b, rays)])


def seen_cells(origins: DataFrame, plan: DataFrame, rays: int = MASK_RAYS) -> DataFrame:
    """origins: plan_id, ox, oy. (plan_id, ox, oy, x, y) of the cells that rays pass before they meet a wall or leave the plan; the origin is one."""
    each = looks(origins.select("plan_id", "ox", "oy").distinct(), plan, rays).select("plan_id", "ox", "oy", "w", F.posexplode("seen").alias("at", "seen")).where("seen")
    return each.select("plan_id", "ox", "oy", (F.col("at") % F.col("w")).cast("int").alias("x"), F.floor(F.col("at") / F.col("w")).cast("int").alias("y"))


def isovists(origins: DataFrame, plan: DataFrame, rays: int = ISOVIST_RAYS, jump: float = JUMP) -> DataFrame:
    """origins: plan_id, ox, oy. Per origin the measures of its isovist.

    Lengths are in cells. An edge between neighbouring rays occludes if their lengths differ by over `jump` or either
    left the plan; the rest of the perimeter is real. Elongation and jaggedness are null where they have no finite value.
    """
    o = _spread(origins.select("plan_id", "ox", "oy").join(grids(plan), "plan_id").where(_inside(F.col("ox"), F.col("oy"))))
    names = ["fans", "perimeter", "occlusivity", "min_radial", "max_radial", "mean_radial", "radial_variance", "third", "dx", "dy"]
    o = _over(o.select("plan_id", "ox", "oy", "w", "h", "free"), ["plan_id", "ox", "oy"], ", ".join(f"{n} double" for n in names) + ", closed boolean", lambda b: _measured(b, rays, jump))
    o = o.withColumn("area", 0.5 * math.sin(2 * math.pi / rays) * F.col("fans"))
    round_ = F.coalesce(F.try_divide(4 * math.pi * F.col("area"), F.col("perimeter") * F.col("perimeter")), F.lit(0.0))
    return o.select(
        "plan_id", "ox", "oy", "area", "perimeter", (F.col("perimeter") - F.col("occlusivity")).alias("real_surface_perimeter"), "occlusivity", "min_radial", "max_radial", "mean_radial", "radial_variance",
        F.when(F.col("radial_variance") > 0, F.col("third") / F.pow("radial_variance", F.lit(1.5))).otherwise(0.0).alias("radial_skewness"), round_.alias("compactness"), round_.alias("circularity"),
        F.try_divide("max_radial", "min_radial").alias("elongation"), F.try_divide(F.col("perimeter") * F.col("perimeter"), "area").alias("jaggedness"), F.hypot("dx", "dy").alias("drift_magnitude"), F.atan2("dy", "dx").alias("drift_angle"),
        F.coalesce(F.try_divide(F.sqrt("radial_variance"), "mean_radial"), F.lit(0.0)).alias("dispersion"), "closed",
    )


@lru_cache(maxsize=4)
def _line_cells(w: int, h: int) -> list[np.ndarray]:
    """Per cell the cells [other, sample] of its lines to all later ones, the last sample repeated."""
    out = []
    for a in range(w * h):
        ways = []
        for b in range(a + 1, w * h):
            x, y = line_samples(b % w - a % w, b // w - a // w)
            cell = (np.floor(a // w + y) * w + np.floor(a % w + x)).astype("int64")
            ways.append(np.pad(cell, (0, 2 * max(w, h) - len(cell)), "edge"))
        out.append(np.array(ways, "int64").reshape(-1, 2 * max(w, h)))
    return out


def _linked(batch: pa.RecordBatch, stride: int) -> list[pa.Array]:
    """Per plan lists of its nodes: cell, neighbours, pairs of neighbours that see one another (both ways), nodes reached and the sum of their depths."""
    found: list[tuple] = [()] * batch.num_rows
    for rows, (w, h, _, _), free in _alike(batch):
        v = w * h
        at = np.arange(v)
        node = free[:-1] & ((at % w % stride == 0) & (at // w % stride == 0))[:, None]
        for part in np.array_split(np.arange(len(rows)), -(-len(rows) * v * v // CELLS)):
            near = np.zeros((v, v, len(part)), bool)
            for a, ways in enumerate(_line_cells(w, h)):
                near[a, a + 1 :] = free[:, part][ways].all(1) & node[a, part] & node[a + 1 :, part]
            own = np.ascontiguousarray((near | near.transpose(1, 0, 2)).transpose(2, 0, 1)).astype("float32")
            links = (own @ own * own).sum(2)
            step, met, depth = own + np.eye(v, dtype="float32"), own > 0, 1
            met |= np.eye(v, dtype=bool)
            reached = own.sum(2)
            total = reached.copy()
            while True:
                now = met.astype("float32") @ step > 0
                new = (now & ~met).sum(2)
                if not new.any():
                    break
                depth += 1
                reached, total, met = reached + new, total + depth * new, now
            for i, r in enumerate(rows[part]):
                here = np.flatnonzero(node[:, part[i]])
                found[r] = (here, *(m[i][here] for m in (own.sum(2), links, reached, total)))
    offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype("int32")
    flat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(5)]
    return [pa.ListArray.from_arrays(offsets, pa.array(c.astype("int64"))) for c in flat]


def _small_graphs(g: DataFrame, stride: int) -> DataFrame:
    """(plan_id, x, y, n, k, links, reached, total) of plans g (as of `grids`) by matrices of their cells, a batch of plans at a time."""
    names = ["at", "k", "links", "reached", "total"]
    g = g.select("plan_id", "w", "h", "free").repartition(int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")), "plan_id")
    each = _over(g.withColumns({"ox": F.lit(0), "oy": F.lit(0)}), ["plan_id", "w"], ", ".join(f"{n} array<bigint>" for n in names), lambda b: _linked(b, stride))
    each = each.select("plan_id", "w", F.size("at").cast("long").alias("n"), F.explode(F.arrays_zip(*names)).alias("c")).select("plan_id", "w", "n", "c.*")
    return each.select("plan_id", (F.col("at") % F.col("w")).cast("int").alias("x"), F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), "n", "k", "links", "reached", "total")


def _large_graphs(g: DataFrame, stride: int) -> DataFrame:
    """As `_small_graphs`, by joins: edges are rows, depths are rounds of a frontier, each joined with the edges."""
    cells = g.select("plan_id", "w", "free", F.posexplode("free").alias("v", "open")).where("open")
    nodes = cells.withColumns({"x": (F.col("v") % F.col("w")).cast("int"), "y": F.floor(F.col("v") / F.col("w")).cast("int")}).where(f"x % {stride} = 0 and y % {stride} = 0")
    a = nodes.select("plan_id", "w", "free", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("v").alias("a"))
    b = nodes.select("plan_id", "x", "y", F.col("v").alias("b"))
    seen = a.join(b, "plan_id").where("a < b").where(line_is_free(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).select("plan_id", "a", "b")
    edges = seen.unionByName(seen.select("plan_id", F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    near = edges.groupBy("plan_id", "a").agg(F.collect_list("b").alias("near"))
    other = near.select("plan_id", F.col("a").alias("b"), F.col("near").alias("near2"))
    shared = edges.join(near, ["plan_id", "a"]).join(other, ["plan_id", "b"]).groupBy("plan_id", "a").agg(F.count("*").alias("k"), F.sum(F.size(F.array_intersect("near", "near2"))).alias("links"))
    met = edges.select("plan_id", "a", "b", F.lit(1).alias("depth")).unionByName(nodes.select("plan_id", F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0).alias("depth"))).checkpoint()
    depth = 1
    while True:
        step = met.where(F.col("depth") == depth).select("plan_id", "a", F.col("b").alias("via")).join(edges.select("plan_id", F.col("a").alias("via"), "b"), ["plan_id", "via"]).select("plan_id", "a", "b").distinct()
        new = step.join(met, ["plan_id", "a", "b"], "left_anti").withColumn("depth", F.lit(depth + 1)).checkpoint()
        if new.isEmpty():
            break
        met, depth = met.unionByName(new).checkpoint(), depth + 1
    depths = met.where("depth > 0").groupBy("plan_id", "a").agg(F.count("*").alias("reached"), F.sum("depth").alias("total"))
    out = nodes.select("plan_id", "x", "y", F.col("v").alias("a")).join(nodes.groupBy("plan_id").agg(F.count("*").alias("n")), "plan_id").join(depths, ["plan_id", "a"], "left").join(shared, ["plan_id", "a"], "left")
    return out.select("plan_id", "x", "y", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("k", "links", "reached", "total")))


def visibility_graph(plan: DataFrame, stride: int = 1, small: int = SMALL) -> DataFrame:
    """(plan_id, x, y, connectivity, mean_depth, integration, clustering) of the free cells whose coordinates `stride` divides.

    Edges are pairs of cells that see one another. Integration is the inverse of the real relative asymmetry among all n cells of
    the plan, 0 where the mean depth is 1 at most; a cell that reaches none has no mean depth. Clustering is the share of a cell's
    pairs of neighbours that see one another. Plans of at most `small` cells, whose pairs fit a matrix, are done a batch of plans at
    a time; those of more by joins, so that no plan's pairs meet in one task.
    """
    checkpoint_dir(plan.sparkSession)
    g = grids(plan).checkpoint()
    fits = (F.col("w") * F.col("h") <= small) & (F.greatest("w", "h") <= SIDE)
    out, large = _small_graphs(g.where(fits), stride), g.where(~fits)
    if not large.isEmpty():
        out = out.unionByName(_large_graphs(large, stride))
    n, k = F.col("n"), F.col("k").cast("int")
    out = out.withColumn("mean_depth", F.try_divide("total", "reached"))
    d = 2 * (n * (F.log2((n + 2) / 3) - 1) + 1) / ((n - 1) * (n - 2))
    inverse = F.when((n > 2) & (F.col("mean_depth") > 1), F.greatest(d / (2 * (F.col("mean_depth") - 1) / (n - 2)), F.lit(0.0))).otherwise(0.0)
    return out.select("plan_id", "x", "y", k.alias("connectivity"), "mean_depth", inverse.alias("integration"), F.when(k > 1, F.col("links") / (k * (k - 1))).otherwise(0.0).alias("clustering"))
