"""Walls of an image: one mask parted by jumps of depth and by corners, parts of like colour joined, fragments given to the nearest in depth.

Images are arrays, row by row: gradients of depth and the widening of edges stay in their row. Regions, their adjacency and
their sums are joins and aggregations of pixels; merging runs over an image's few regions, as arrays of its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir
from .edges import clamped, lines
from .regions import regions, unfolded

# Jump of depth, widening of edges and reach of neighbours in steps, difference of colours, least area, share of a side at a split, most lines, tilt in degrees and angles tried.
JUMP, WIDEN, REACH, COLOUR, AREA, SIDE, LINES, TILT, ANGLES = 0.12, 2, 3, 20.0, 1000, 0.2, 5, 15, 20
BACK, LEFT, RIGHT = 0.15, 0.7, 1.3


def _near(steps: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-steps, steps + 1) for dx in range(-steps, steps + 1) if abs(dx) + abs(dy) <= steps]


def slope(g: Column, width: int, i: Column) -> Column:
    """Length of Sobel's gradient at pixel i."""
    at = lambda dx, dy: clamped(g, width, i, dx, dy)
    dx = (at(1, -1) - at(-1, -1)) + 2 * (at(1, 0) - at(-1, 0)) + (at(1, 1) - at(-1, 1))
    dy = (at(-1, 1) - at(-1, -1)) + 2 * (at(0, 1) - at(0, -1)) + (at(1, 1) - at(1, -1))
    return F.sqrt(dx * dx + dy * dy)


def whole_surfaces(images: DataFrame, key: str, width: int, wall: str, depth: str, jump: float = JUMP, widen: int = WIDEN) -> DataFrame:
    """(key, x, y): wall pixels farther than `widen` steps from any wall pixel where depth jumps."""
    every = F.sequence(F.lit(0), F.size(depth) - 1)
    marked = images.withColumn("__jump", F.transform(every, lambda i: F.get(wall, i) & (slope(F.col(depth), width, i) > jump)))
    inside = lambda i, dx, dy: (i % width + dx).between(0, width - 1) & (i + dy * width).between(0, F.size(depth) - 1)
    hit = lambda i: F.lit(False) if widen < 0 else _any(inside(i, dx, dy) & F.get("__jump", (i + dy * width + dx).cast("int")) for dx, dy in _near(widen))
    kept = marked.select(key, F.explode(F.filter(every, lambda i: F.get(wall, i) & ~hit(i))).alias("pos"))
    return kept.select(key, (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def corner_columns(edges: DataFrame, key: str, width: int, height: int, around: float = math.pi / 2, most: int = LINES) -> DataFrame:
    """(key, rank, column): where strong, nearly straight lines among edge pixels (key, x, y) part the image.

    Lines are tried at ANGLES angles up to TILT degrees from `around`. A line counts if its ends at the top and bottom of the
    image, held inside, are less than a tenth of the width apart; the column is between them and inside.
    """
    tilt = math.radians(TILT)
    angles = [around - tilt + 2 * tilt * i / (ANGLES - 1) for i in range(ANGLES)]
    turn = F.array(*(F.lit(a) for a in angles))
    found = lines(edges, key, angles, most).withColumn("t", F.get(turn, F.col("angle").cast("int")))
    end = lambda y: F.least(F.greatest(((F.col("rho") - y * F.sin("t")) / (F.cos("t") + 1e-8)).cast("int"), F.lit(0)), F.lit(width - 1))
    ends = found.select(key, "rank", end(0).alias("a"), end(height).alias("b")).where(F.abs(F.col("b") - F.col("a")) < width * 0.1)
    return ends.select(key, "rank", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("column")).where(F.col("column").between(1, width - 2))


def split_at(pixels: DataFrame, key: str, columns: DataFrame, most: int = LINES) -> DataFrame:
    """Pixels (key, x, y, region) with regions parted at each image's columns (key, rank, column), one after the other.

    A region that has over SIDE of its pixels on both sides of a column gets a new number for the right one.
    """
    checkpoint_dir(pixels.sparkSession)
    pixels, columns = pixels.checkpoint(), columns.checkpoint()
    for k in range(1, min(columns.agg(F.max("rank")).first()[0] or 0, most) + 1):
        at = columns.where(F.col("rank") == k).select(key, "column")
        sides = pixels.join(at, key).groupBy(key, "column", "region").agg(F.count_if(F.col("x") < F.col("column")).alias("left"), F.count("*").alias("size"))
        last = pixels.groupBy(key).agg(F.max("region").alias("last"))
        parted = sides.where((F.col("left") > SIDE * F.col("size")) & (F.col("size") - F.col("left") > SIDE * F.col("size"))).join(last, key)
        new = parted.select(key, "region", "column", (F.col("last") + F.row_number().over(W.partitionBy(key).orderBy("region"))).alias("new"))
        pixels = pixels.join(new, [key, "region"], "left").select(key, "x", "y", F.when(F.col("x") >= F.col("column"), F.col("new")).otherwise(F.col("region")).alias("region")).checkpoint()
    return pixels


def touching(pixels: DataFrame, key: str, steps: int = REACH) -> DataFrame:
    """(key, a, b): regions with pixels at most `steps` apart along rows and columns, a < b. Only pixels at a region's rim are compared."""
    side = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    own = pixels.select(key, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("region").alias("other"))
    sides = pixels.select(key, "x", "y", "region", F.explode(side).alias("o")).select(key, "x", "y", "region", (F.col("x") + F.col("o.dx")).alias("x2"), (F.col("y") + F.col("o.dy")).alias("y2"))
    rim = sides.join(own.withColumnRenamed("other", "region"), [key, "x2", "y2", "region"], "left_anti").select(key, "x", "y", "region").distinct()
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _near(steps) if (dy, dx) > (0, 0)))
    met = rim.select(key, "region", F.explode(moves).alias("o"), "x", "y").select(key, "region", (F.col("x") + F.col("o.dx")).alias("x2"), (F.col("y") + F.col("o.dy")).alias("y2"))
    back = rim.select(key, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("region").alias("other"))
    pairs = met.join(back, [key, "x2", "y2"]).where("region <> other")
    return pairs.select(key, F.least("region", "other").alias("a"), F.greatest("region", "other").alias("b")).distinct()


def joined_by_colour(stats: DataFrame, near: DataFrame, key: str, colour: float = COLOUR) -> DataFrame:
    """(key, region, root): regions (1, 2, ... of an image) that take in later ones of like mean colour.

    In the order of their numbers, a region that hasn't been taken in itself takes each later one whose colour is within `colour`
    of its own first colour and that touches it or anything that it has taken in so far.
    """
    met = near.select(key, "a", "b").unionByName(near.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(key, F.col("b").alias("region")).agg(F.collect_set("a").alias("near"))
    own = stats.join(met, [key, "region"], "left").select(key, F.struct("region", "r", "g", "b", F.coalesce("near", F.array().cast("array<int>")).alias("near")).alias("s"))
    rows = own.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("all"))
    like = lambda p, q: (p["r"] - q["r"]) * (p["r"] - q["r"]) + (p["g"] - q["g"]) * (p["g"] - q["g"]) + (p["b"] - q["b"]) * (p["b"] - q["b"]) < colour * colour
    pairs = F.flatten(F.transform("all", lambda p: F.transform(F.filter("all", lambda q: (q["region"] > p["region"]) & like(p, q)), lambda q: F.struct(p["region"].alias("a"), q["region"].alias("b"), q["near"].alias("near")))))
    root = lambda roots, k: F.get(roots, k - 1)

    def take(roots: Column, p: Column) -> Column:
        ok = (root(roots, p["a"]) == p["a"]) & (root(roots, p["b"]) == p["b"]) & F.exists(p["near"], lambda m: root(roots, m) == p["a"])
        return F.when(ok, F.transform(roots, lambda r, i: F.when(i == p["b"] - 1, p["a"]).otherwise(r))).otherwise(roots)

    merged = rows.withColumn("pairs", pairs).select(key, F.aggregate("pairs", F.transform("all", lambda s: s["region"]), take).alias("roots"))
    return merged.select(key, F.posexplode("roots").alias("i", "root")).select(key, (F.col("i") + 1).alias("region"), "root")


def _renumbered(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.withColumn(column, F.dense_rank().over(W.partitionBy(key).orderBy(column)))


def walls(images: DataFrame, key: str, width: int, columns: DataFrame | None = None, jump: float = JUMP, area: int = AREA, colour: float = COLOUR) -> DataFrame:
    """Per wall of an image: key, wall (from 1), size, area_fraction (of the image's walls), mean_depth, x, y (centroid), windows, doors, viewpoint, salience.

    images: key and arrays wall (boolean), depth, r, g, b, window, door (boolean). columns: as of `corner_columns`. An image whose
    depth is null is one wall, at depth 0.5, and area_fraction is its share of the image; one without wall pixels has no row.
    """
    checkpoint_dir(images.sparkSession)
    deep = images.where("depth IS NOT NULL")
    # a region's number follows from the mask alone, so the pixels can be found again; they are kept since every step needs them
    parts = unfolded(regions(whole_surfaces(deep, key, width, "wall", "depth", jump), key), key)
    parts = split_at(parts, key, columns) if columns is not None else parts.checkpoint()
    each = deep.select(key, F.posexplode(F.arrays_zip("wall", "depth", "r", "g", "b", "window", "door")).alias("pos", "p")).where("p.wall")
    pixels = each.select(key, (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), "p.*").join(parts, [key, "x", "y"])
    sums = pixels.groupBy(key, "region").agg(F.count("*").alias("size"), *(F.sum(c).alias(c) for c in ("depth", "r", "g", "b", "x", "y")), F.bool_or("window").alias("windows"), F.bool_or("door").alias("doors")).checkpoint()
    colours = sums.select(key, "region", *((F.col(c) / F.col("size")).alias(c) for c in "rgb"))
    roots = joined_by_colour(colours, touching(parts, key), key, colour)
    by_root = _added(sums.join(roots, [key, "region"]).withColumn("wall", F.col("root")), key)
    by_root = _renumbered(by_root, key, "wall").checkpoint()
    # fragments go to the large wall that is nearest in depth, of equally near ones the first
    mean = F.col("depth") / F.col("size")
    large = by_root.where(F.col("size") >= area).groupBy(key).agg(F.collect_list(F.struct(mean.alias("at"), F.col("wall"))).alias("large"))
    nearest = F.array_min(F.transform("large", lambda w: F.struct(F.abs(w["at"] - mean).alias("d"), w["wall"].alias("wall"))))["wall"]
    whole = _added(by_root.join(large, key, "left").withColumn("wall", F.when((F.col("size") < area) & F.col("large").isNotNull(), nearest).otherwise(F.col("wall"))), key)
    out = _renumbered(whole, key, "wall").select(key, "wall", "size", (F.col("size") / F.sum("size").over(W.partitionBy(key))).alias("area_fraction"), mean.alias("mean_depth"), (F.col("x") / F.col("size")).alias("x"), (F.col("y") / F.col("size")).alias("y"), "windows", "doors")
    return labelled(out, key, width).unionByName(_undivided(images.where("depth IS NULL"), key, width))


def _added(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key, "wall").agg(*(F.sum(c).alias(c) for c in ("size", "depth", "x", "y")), F.bool_or("windows").alias("windows"), F.bool_or("doors").alias("doors"))


def labelled(found: DataFrame, key: str, width: int) -> DataFrame:
    """viewpoint: the deepest wall of over BACK of the area is the back one, others lie by their centroid; salience: the first wall with a window, or the first, is focal."""
    big = F.col("area_fraction") > BACK
    deepest = F.row_number().over(W.partitionBy(key).orderBy(big.desc(), F.col("mean_depth").desc(), F.col("size").desc(), "wall")) == 1
    side = F.when(F.col("x") < width / 2 * LEFT, "wall.left").when(F.col("x") > width / 2 * RIGHT, "wall.right").otherwise("wall.center")
    focal = F.row_number().over(W.partitionBy(key).orderBy(F.col("windows").desc(), "wall")) == 1
    return found.withColumn("viewpoint", F.when(deepest & big, "wall.back").otherwise(side)).withColumn("salience", F.when(focal, "wall.focal").otherwise("wall.flanking"))


def _undivided(images: DataFrame, key: str, width: int) -> DataFrame:
    each = images.select(key, F.size("wall").alias("all"), F.posexplode(F.arrays_zip("wall", "window", "door")).alias("pos", "p")).where("p.wall")
    one = each.groupBy(key, "all").agg(F.count("*").alias("size"), F.avg(F.col("pos") % width).alias("x"), F.avg(F.floor(F.col("pos") / width)).alias("y"), F.bool_or("p.window").alias("windows"), F.bool_or("p.door").alias("doors"))
    return one.select(key, F.lit(1).alias("wall"), "size", (F.col("size") / F.col("all")).alias("area_fraction"), F.lit(0.5).alias("mean_depth"), "x", "y", "windows", "doors", F.lit("wall.back").alias("viewpoint"), F.lit("wall.focal").alias("salience"))


def wall_counts(images: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, walls): also of images without any."""
    return images.select(key).join(found.groupBy(key).agg(F.count("*").alias("walls")), key, "left").select(key, F.coalesce("walls", F.lit(0)).alias("walls"))
