"""Statistics of images that are one array a row (row by row, with a width): no pixel leaves its row, so nothing is shuffled.

Neighbours are found by index, in higher-order functions of the JVM. Pass plain columns: an expression is worked out again for each pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours(g: Column, width: int, dx: int, dy: int) -> Column:
    """(a, b) of each pixel and the one dx to its right and dy below, where that's inside."""
    rows = F.floor(F.size(g) / width)
    inside = lambda i: (i % width + dx).between(0, width - 1) & (F.floor(i / width) + dy).between(0, rows - 1)
    at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), inside)
    return F.transform(at, lambda i: F.struct(F.get(g, i).alias("a"), F.get(g, i + dy * width + dx).alias("b")))


def mean_of(pairs: Column, value) -> Column:
    """The mean of value(pair); null without pairs."""
    return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + value(p)), F.size(pairs))


def quantised(pairs: Column, levels: int = 64, top: int = 256) -> Column:
    q = lambda v: F.floor(v * levels / top).cast("int")
    return F.transform(pairs, lambda p: F.struct(q(p["a"]).alias("a"), q(p["b"]).alias("b")))


def contrast(pairs: Column) -> Column:
    return mean_of(pairs, lambda p: ((p["a"] - p["b"]) * (p["a"] - p["b"])).cast("double"))


def homogeneity(pairs: Column) -> Column:
    return mean_of(pairs, lambda p: 1 / (1 + (p["a"] - p["b"]) * (p["a"] - p["b"])))


def mirrored(g: Column, width: int) -> Column:
    """(a, b) of each pixel of the left half and its mirror image."""
    at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: i % width < width // 2)
    return F.transform(at, lambda i: F.struct(F.get(g, i).alias("a"), F.get(g, i + width - 1 - 2 * (i % width)).alias("b")))


def correlation(pairs: Column) -> Column:
    """Of a and b; null where one of them is all the same."""
    n = F.size(pairs)
    s = F.aggregate(pairs, F.struct(*(F.lit(0.0).alias(k) for k in ("a", "b", "aa", "bb", "ab"))), lambda t, p: F.struct((t["a"] + p["a"]).alias("a"), (t["b"] + p["b"]).alias("b"), (t["aa"] + p["a"] * p["a"]).alias("aa"), (t["bb"] + p["b"] * p["b"]).alias("bb"), (t["ab"] + p["a"] * p["b"]).alias("ab")))
    va, vb = n * s["aa"] - s["a"] * s["a"], n * s["bb"] - s["b"] * s["b"]
    return F.when((va > 0) & (vb > 0), (n * s["ab"] - s["a"] * s["b"]) / F.sqrt(va * vb))


def edges(g: Column, width: int, threshold: int) -> Column:
    """The number of pixels that differ from the next one or the one below by over the threshold."""
    n = F.size(g)
    step = lambda i, j, inside: F.when(inside, F.abs(F.get(g, j) - F.get(g, i))).otherwise(0)
    hit = lambda i: F.greatest(step(i, i + 1, i % width < width - 1), step(i, i + width, i + width < n)) > threshold
    return F.size(F.filter(F.sequence(F.lit(0), n - 1), hit)).cast("long")


def spatial_entropy(images: DataFrame, key: str, g: str, width: int) -> DataFrame:
    """Per image the entropy of the co-occurrence of greys in 32 levels at distance 1 and three angles, both ways, over 10 and at most 1.

    The three matrices each add up to 1 and their entropies are added. Only counts of pairs of levels are shuffled.
    """
    ways = [F.flatten(F.transform(quantised(neighbours(F.col(g), width, dx, dy), 32), lambda p: F.array(p["a"] * 32 + p["b"], p["b"] * 32 + p["a"]))) for dx, dy in ((1, 0), (1, -1), (0, -1))]
    each = images.select(key, F.posexplode(F.array(*ways)).alias("k", "vs")).select(key, "k", F.explode("vs").alias("v")).groupBy(key, "k", "v").agg(F.count("*").alias("n"))
    one = each.groupBy(key, "k").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("e"))
    return one.groupBy(key).agg(F.least(F.sum("e") / 10, F.lit(1.0)).alias("entropy"))


# --- colours, a row a pixel


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0..1, saturation in 0..1, value in 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    h = F.when(d == 0, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return h, F.when(top > 0, d / top).otherwise(0.0), top.cast("double")


#: Centres of the hue bins, the half width of each, and the saturation under which a pixel is white.
HUES = [("red", 0.0), ("yellow", 60 / 360), ("green", 120 / 360), ("cyan", 180 / 360), ("blue", 240 / 360), ("magenta", 300 / 360)]
HALF_WIDTH, NEUTRAL = 1 / 12, 0.05


def hue_shares(h: Column, s: Column) -> list[Column]:
    """Shares of the group's pixels in each hue bin, and white ones."""
    out = [F.avg(((s >= NEUTRAL) & (F.least(F.abs(h - c), 1 - F.abs(h - c)) < HALF_WIDTH)).cast("double")).alias(n) for n, c in HUES]
    return [*out, F.avg((s < NEUTRAL).cast("double")).alias("white")]


def material_masks(h: Column, s: Column, v: Column, grey: Column, local: Column) -> dict[str, Column]:
    """Which materials a pixel may be. local: squared difference of its grey from the mean around it. Hue and saturation as bytes (0..179, 0..255)."""
    hue, sat = h * 180, s * 255
    return {
        "wood": hue.between(5, 30) & (sat > 30) & (v > 50), "metal": (sat < 30) & (v > 150), "glass": (grey > 200) & (local < 100), "stone_concrete": (sat < 60) & (v > 60) & (v < 200),
        "plaster_gypsum": (sat < 30) & (v > 180), "tile_ceramic": (v > 150) & (sat > 40) & (local > 50),
    }
