"""Maps of the fractal dimension of edges: a box count at every place of a sliding window, by summed-area tables.

A table holds at each place the sum of all above and to the left, made by two running sums; the sum over any rectangle is then
four of its values. Two tables do all windows at once: one over pixels says which boxes hold an edge, and one over these
boxes, for each size and each phase of their lattice, how many of them a window holds. So no window is gone through.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Side of the window, its stride, least share of edge pixels, least fit, and between which dimensions a value counts.
WINDOW, STRIDE, SHARE, FIT, LEAST, MOST = 64, 8, 0.01, 0.9, 0.5, 2.5


def summed(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, x, y, s): at each cell (keys, x, y, value) of a full lattice the sum of all cells at most as far right and down."""
    along = cells.select(*keys, "x", "y", F.sum(value).over(W.partitionBy(*keys, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    return along.select(*keys, "x", "y", F.sum("s").over(W.partitionBy(*keys, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)).alias("s"))


def rectangle_sums(table: DataFrame, keys: list[str], wanted: DataFrame, name: str) -> DataFrame:
    """The rows of wanted (keys, x, y: first cell, x2, y2: last cell) with the sum over the rectangle, as a sum of four corners."""
    corner = lambda sign, x, y: F.struct(F.lit(sign).alias("sign"), F.col(x).alias("cx") if x != "x" else (F.col(x) - 1).alias("cx"), F.col(y).alias("cy") if y != "y" else (F.col(y) - 1).alias("cy"))
    corners = F.array(corner(1, "x2", "y2"), corner(-1, "x", "y2"), corner(-1, "x2", "y"), corner(1, "x", "y"))
    asked = wanted.withColumn("c", F.explode(corners)).select(*wanted.columns, "c.*")
    # both sides grow with the images, so neither is broadcast, however small its blocks are compressed
    met = asked.join(table.select(*keys, F.col("x").alias("cx"), F.col("y").alias("cy"), "s").hint("merge"), [*keys, "cx", "cy"])
    return met.groupBy(*wanted.columns).agg(F.sum(F.col("sign") * F.col("s")).alias(name))


def _steps(size: str, step: int, room: int):
    """0, step, 2 step, ... as far as `room` cells fit."""
    return F.expr(f"filter(sequence(0, greatest({size} - {room}, 0), {step}), v -> v + {room} <= {size})")


def dimension_map(edges: DataFrame, key: str, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """edges: key, x, y, edge (0 or 1) for every pixel. (key, x, y, dimension): the windows, by their first pixel, that have one.

    Boxes are of 4, 8, ... pixels up to the window's side. The dimension is that of the line through the logarithms of sizes and of
    counts of boxes with edges; a window counts if at least SHARE of its pixels are edges, the line fits and the value is in range.
    """
    n = window.bit_length() - 1
    sizes = [2**k for k in range(2, n + 1)]
    if len(sizes) < 2:
        raise ValueError("a window has at least 8 pixels a side")
    dims = edges.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    table = summed(edges, [key], "edge")
    # boxes at all places where a window may have one; those cut by the window's far side, where sizes don't divide it, are shorter
    if window & (window - 1):
        raise ValueError("the window's side must be a power of two")
    boxes = None
    for s in sizes:
        own = dims.select(key, F.lit(s).alias("size"), F.explode(_steps("w", gcd(s, stride), s)).alias("x"), "h").select(key, "size", "x", F.explode(_steps("h", gcd(s, stride), s)).alias("y"))
        boxes = own if boxes is None else boxes.unionByName(own)
    boxes = boxes.withColumn("x2", F.col("x") + F.col("size") - 1).withColumn("y2", F.col("y") + F.col("size") - 1)
    full = rectangle_sums(table, [key], boxes, "inside")
    # boxes of one size whose places differ by whole boxes form a lattice
    phase = [F.pmod("x", "size").alias("px"), F.pmod("y", "size").alias("py")]
    lattice = full.select(key, "size", *phase, F.floor(F.col("x") / F.col("size")).cast("int").alias("x"), F.floor(F.col("y") / F.col("size")).cast("int").alias("y"), (F.col("inside") > 0).cast("int").alias("full"))
    counted = summed(lattice, [key, "size", "px", "py"], "full")
    places = dims.select(key, F.explode(_steps("w", stride, window)).alias("ox"), "h").select(key, "ox", F.explode(_steps("h", stride, window)).alias("oy"))
    each = places.select(key, "ox", "oy", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    first = lambda o: F.floor(F.col(o) / F.col("size")).cast("int")
    asked = each.select(key, "ox", "oy", "size", F.pmod("ox", "size").alias("px"), F.pmod("oy", "size").alias("py"), first("ox").alias("x"), first("oy").alias("y")).withColumn("x2", F.col("x") + (F.lit(window) / F.col("size")).cast("int") - 1).withColumn("y2", F.col("y") + (F.lit(window) / F.col("size")).cast("int") - 1)
    counts = rectangle_sums(counted, [key, "size", "px", "py"], asked, "boxes")
    inside = rectangle_sums(table, [key], places.select(key, F.col("ox").alias("x"), F.col("oy").alias("y"), (F.col("ox") + window - 1).alias("x2"), (F.col("oy") + window - 1).alias("y2")), "edges")
    a, b = F.log(F.col("size").cast("double")), F.log(F.col("boxes") + 1e-10)
    fits = counts.groupBy(key, F.col("ox").alias("x"), F.col("oy").alias("y")).agg((-F.regr_slope(b, a)).alias("dimension"), F.regr_syy(b, a).alias("syy"), F.regr_sxx(b, a).alias("sxx"))
    # what the line leaves is syy - slope * slope * sxx
    fit = 1 - (F.col("syy") - F.col("dimension") * F.col("dimension") * F.col("sxx")) / (F.col("syy") + 1e-10)
    held = fits.join(inside.where(F.col("edges") >= SHARE * window * window).select(key, "x", "y").hint("merge"), [key, "x", "y"])
    return held.where((fit > FIT) & (F.col("dimension") > LEAST) & (F.col("dimension") < MOST)).select(key, "x", "y", "dimension")


def pooled(found: DataFrame, key: str) -> DataFrame:
    """(key, windows, mean, sd): over an image's windows that have a dimension."""
    return found.groupBy(key).agg(F.count("*").alias("windows"), F.avg("dimension").alias("mean"), F.stddev_pop("dimension").alias("sd"))
