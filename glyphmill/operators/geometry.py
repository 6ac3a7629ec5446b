"""Plan geometry: visibility between cells, isovists, graph measures, sound, mirrors.

A plan is rows (plan_id, x, y, wall). Plans are small (hundreds of cells), many, and independent: kernels run a plan a group.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(p: pd.DataFrame) -> np.ndarray:
    """Walls as bool [y, x]; what's not given is wall."""
    out = np.ones((int(p.y.max()) + 1, int(p.x.max()) + 1), bool)
    out[p.y.to_numpy(int), p.x.to_numpy(int)] = p.wall.to_numpy(bool)
    return out


def _kernel(f, schema: str):
    def run(df: DataFrame) -> DataFrame:
        return df.groupBy("plan_id").applyInPandas(f, schema)

    return run


def intelligibility(graph: DataFrame) -> DataFrame:
    """How well a plan's connectivity tells its integration: the squared correlation, 0 where either is constant."""
    g = graph.groupBy("plan_id").agg(F.covar_pop("connectivity", "integration").alias("both"), F.var_pop("connectivity").alias("c"), F.var_pop("integration").alias("i"))
    told = F.when((F.sqrt("c") > 1e-9) & (F.sqrt("i") > 1e-9), F.try_divide(F.col("both") * F.col("both"), F.col("c") * F.col("i"))).otherwise(0.0)
    return g.select("plan_id", told.alias("intelligibility"))


def line_samples(dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (x, y) of the samples of a line from a cell to the one dx, dy away: 2 d + 2 of them where its longer side is d."""
    n = 2 * max(abs(dx), abs(dy)) + 1
    part = np.arange(n + 1) / n
    return dx * part, dy * part


def line_of_sight(walls: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether all samples of the line from a to b lie in free cells."""
    x, y = line_samples(b[0] - a[0], b[1] - a[1])
    return not walls[np.floor(a[1] + y).astype(int), np.floor(a[0] + x).astype(int)].any()


def geodesic(walls: np.ndarray, start: tuple[int, int], cost: np.ndarray | None = None) -> np.ndarray:
    """Distance from start over free cells with eight neighbours, each step weighted by the cost of the cell it enters."""
    h, w = walls.shape
    out = np.full((h, w), np.inf)
    out[start[1], start[0]] = 0.0
    todo = [(0.0, start)]
    while todo:
        d, (x, y) = heapq.heappop(todo)
        if d > out[y, x]:
            continue
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                a, b = x + dx, y + dy
                if (dx or dy) and 0 <= a < w and 0 <= b < h and not walls[b, a]:
                    e = d + math.hypot(dx, dy) * (1.0 if cost is None else float(cost[b, a]))
                    if e < out[b, a]:
                        out[b, a] = e
                        heapq.heappush(todo, (e, (a, b)))
    return out


def _distances(p: pd.DataFrame) -> pd.DataFrame:
    w = grid(p)
    y0, x0 = (int(v[0]) for v in np.nonzero(~w)) if (~w).any() else (0, 0)
    d = geodesic(w, (x0, y0))
    y, x = np.nonzero(np.isfinite(d))
    return pd.DataFrame({"plan_id": p.plan_id.iloc[0], "x": x.astype("int32"), "y": y.astype("int32"), "distance": d[y, x]})


distances = _kernel(_distances, "plan_id long, x int, y int, distance double")


def mirror_exposure(surfaces: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """surfaces: plan_id, x1, y1, x2, y2; viewpoints: plan_id, px, py. The mirror image, its distance, and whether one sees oneself.

    One sees oneself where the foot of the perpendicular falls on the surface.
    """
    j = viewpoints.join(surfaces, "plan_id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, dx * dx + dy * dy)
    fx, fy = F.col("x1") + t * dx, F.col("y1") + t * dy
    return j.select("plan_id", "px", "py", (2 * fx - F.col("px")).alias("ix"), (2 * fy - F.col("py")).alias("iy"), (2 * F.hypot(fx - F.col("px"), fy - F.col("py"))).alias("image_distance"), F.coalesce(t.between(0, 1), F.lit(False)).alias("self_visible"))
