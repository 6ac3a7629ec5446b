"""Edges of images by gradient, non-maximum suppression and hysteresis, and straight lines by votes.

Gradients and suppression are column expressions on an image's array, so no pixel leaves its row; only the pixels that stay
become rows, for hysteresis (`regions.reached`) and votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .regions import reached

# Hysteresis thresholds; tan(22.5 degrees) in 15 binary digits, by which directions are told apart.
LOW, HIGH = 50, 150
TAN, DIGITS = 13573, 15


def clamped(g: Column, width: int, i: Column, dx: int, dy: int) -> Column:
    """The pixel dx to the right of i and dy below, or the nearest inside."""
    rows = F.floor(F.size(g) / width).cast("int")
    x = F.least(F.greatest(i % width + dx, F.lit(0)), F.lit(width - 1))
    y = F.least(F.greatest(F.floor(i / width).cast("int") + dy, F.lit(0)), rows - 1)
    return F.get(g, (y * width + x).cast("int"))


def gradients(g: Column, width: int) -> Column:
    """(dx, dy) of each pixel by Sobel's 3 x 3 weights; pixels beyond the border are the border's."""

    def of(i: Column) -> Column:
        at = lambda dx, dy: clamped(g, width, i, dx, dy)
        dx = (at(1, -1) - at(-1, -1)) + 2 * (at(1, 0) - at(-1, 0)) + (at(1, 1) - at(-1, 1))
        dy = (at(-1, 1) - at(-1, -1)) + 2 * (at(0, 1) - at(0, -1)) + (at(1, 1) - at(1, -1))
        return F.struct(dx.alias("dx"), dy.alias("dy"))

    return F.transform(F.sequence(F.lit(0), F.size(g) - 1), of)


def thinned(grad: Column, power: Column, width: int, low: int = LOW, high: int = HIGH) -> Column:
    """Per pixel 0, 1 (weak) or 2 (strong): integer gradients that are largest along their direction and over the thresholds.

    power: squared lengths of grad. Directions are those of the grid's eight neighbours; beyond the border gradients are zero. Of
    equal neighbours along a row or column the first stays, along a diagonal none.
    """
    n = F.size(power)
    at = lambda i, dx, dy: F.when((i % width + dx).between(0, width - 1) & (i + dy * width).between(0, n - 1), F.get(power, (i + dy * width + dx).cast("int"))).otherwise(0)

    def of(i: Column) -> Column:
        m, dx, dy = F.get(power, i), F.get(grad, i)["dx"].cast("long"), F.get(grad, i)["dy"].cast("long")
        x, y = F.abs(dx) * TAN, F.shiftleft(F.abs(dy), DIGITS)
        along_row = y < x
        along_column = y > x + F.shiftleft(F.abs(dx), DIGITS + 1)
        falling = (dx < 0) != (dy < 0)
        best = F.when(along_row, (m > at(i, -1, 0)) & (m >= at(i, 1, 0))).when(along_column, (m > at(i, 0, -1)) & (m >= at(i, 0, 1)))
        best = best.when(falling, (m > at(i, 1, -1)) & (m > at(i, -1, 1))).otherwise((m > at(i, -1, -1)) & (m > at(i, 1, 1)))
        return F.when(~best | (m <= low * low), 0).when(m > high * high, 2).otherwise(1)

    return F.transform(F.sequence(F.lit(0), n - 1), of)


def candidates(images: DataFrame, key: str, g: str, width: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(key, x, y, strong): pixels left by suppression. g: whole greys, row by row."""
    own = images.select(key, g).withColumn("__grad", gradients(F.col(g), width))
    own = own.withColumn("__power", F.transform("__grad", lambda d: (d["dx"] * d["dx"] + d["dy"] * d["dy"]).cast("long")))
    kept = own.select(key, F.posexplode(thinned(F.col("__grad"), F.col("__power"), width, low, high)).alias("pos", "level")).where("level > 0")
    return kept.select(key, (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("level") == 2).alias("strong"))


def edge_pixels(images: DataFrame, key: str, g: str, width: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(key, x, y): strong pixels and the weak ones that are joined with them by sides or corners."""
    return reached(candidates(images, key, g, width, low, high), key, "strong")


def edge_density(images: DataFrame, key: str, g: str, width: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(key, edges, density): edge pixels and their share, 0 where there are none; null without pixels."""
    many = edge_pixels(images, key, g, width, low, high).groupBy(key).agg(F.count("*").alias("edges"))
    all_ = images.select(key, F.size(g).alias("size"))
    return all_.join(many, key, "left").select(key, F.coalesce("edges", F.lit(0)).alias("edges"), F.try_divide(F.coalesce("edges", F.lit(0)), "size").alias("density"))


def votes(points: DataFrame, key: str, angles: list[float]) -> DataFrame:
    """(key, angle, rho, votes): of each point (key, x, y) a vote at every angle for the line x cos + y sin = rho, rounded. Counts are combined before they're shuffled."""
    turns = F.array(*(F.struct(F.lit(i).alias("angle"), F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s")) for i, a in enumerate(angles)))
    cast = points.select(key, "x", "y", F.explode(turns).alias("t")).select(key, "t.angle", F.rint(F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s")).cast("int").alias("rho"))
    return cast.groupBy(key, "angle", "rho").agg(F.count("*").alias("votes"))


def lines(points: DataFrame, key: str, angles: list[float], most: int = 5, apart: int = 9, share: float = 0.5) -> DataFrame:
    """(key, rank, angle, rho, votes): the `most` lines with the most votes.

    A line stays if it has over `share` of the key's most votes and no line with a rho at most `apart` away, at any angle, has more
    (equal ones: the smaller angle, then the smaller rho). Cells without votes can't suppress, so only cast votes are looked at.
    """
    v = votes(points, key, angles)
    # the best line of each rho, then the best within reach of it
    rank = F.struct("votes", (-F.col("angle")).alias("angle"), (-F.col("rho")).alias("rho"))
    each = v.groupBy(key, "rho").agg(F.max(rank).alias("r"))
    near = W.partitionBy(key).orderBy("rho").rangeBetween(-apart, apart)
    top = each.withColumn("best", F.max("r").over(near)).withColumn("top", F.max("r.votes").over(W.partitionBy(key)))
    kept = top.where((F.col("r") == F.col("best")) & (F.col("r.votes") > share * F.col("top")))
    names = kept.select(key, F.col("r.votes").alias("votes"), (-F.col("r.angle")).alias("angle"), "rho")
    order = W.partitionBy(key).orderBy(F.col("votes").desc(), "angle", "rho")
    return names.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "rank", "angle", "rho", "votes")
