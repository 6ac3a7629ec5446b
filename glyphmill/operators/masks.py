"""Overlapping masks merged greedily in their order, and how much of an image they cover.

Masks are rows of pixels (image_id, mask, x, y). Overlaps come from pixels that masks share, so masks apart are never compared.
Masks that are linked by overlaps form clusters, which don't affect one another: each round takes one step in every cluster
of every image at once, and is written to the checkpoint folder. There are at most twice as many rounds as masks in a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir
from .regions import components

# Overlap (intersection over union) above which masks merge, widening in pixels to each side, value above which a pixel is in a mask, least confidence.
OVERLAP, WIDEN, SOLID, CONFIDENCE = 0.3, 2, 0.5, 0.5


def widened(pixels: DataFrame, width: int, height: int, by: int = WIDEN) -> DataFrame:
    """Masks widened by a square of `by` pixels to each side, inside the image."""
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-by, by + 1) for dy in range(-by, by + 1)))
    moved = pixels.select("image_id", "mask", F.explode(moves).alias("m"), "x", "y").select("image_id", "mask", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"))
    return moved.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def overlaps(pixels: DataFrame) -> DataFrame:
    """(image_id, a, b, shared, overlap): pairs of masks that share pixels, a < b."""
    sizes = pixels.groupBy("image_id", "mask").agg(F.count("*").alias("n"))
    other = pixels.select("image_id", "x", "y", F.col("mask").alias("b"))
    shared = pixels.join(other, ["image_id", "x", "y"]).where("mask < b").groupBy("image_id", F.col("mask").alias("a"), "b").agg(F.count("*").alias("shared"))
    sized = shared.join(sizes.select("image_id", F.col("mask").alias("a"), F.col("n").alias("na")), ["image_id", "a"]).join(sizes.select("image_id", F.col("mask").alias("b"), F.col("n").alias("nb")), ["image_id", "b"])
    return sized.select("image_id", "a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("overlap"))


def merged(pixels: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(image_id, mask, root): the mask that each is merged into, the first of its group.

    In their order, each mask that is left takes in later ones: one whose overlap with all that it has taken in so far is over
    `overlap` at the time when it is met. Ones that were passed over aren't looked at again by the same mask.
    """
    if overlap < 0:
        raise ValueError("an overlap below 0 would merge masks that share nothing")
    checkpoint_dir(pixels.sparkSession)
    pixels = pixels.select("image_id", "mask", "x", "y").distinct().checkpoint()
    masks = pixels.groupBy("image_id", "mask").agg(F.count("*").alias("n"))
    linked = components(overlaps(pixels).select("image_id", "a", "b"), "image_id", "a", "b").withColumnRenamed("node", "mask").withColumnRenamed("component", "cluster")
    # masks that overlap with none are their own roots
    left = masks.join(linked, ["image_id", "mask"]).select("image_id", "cluster", "mask", "n").checkpoint()
    own = pixels.join(left.select("image_id", "mask", "cluster"), ["image_id", "mask"]).checkpoint()
    key, done = ["image_id", "cluster"], masks.join(linked, ["image_id", "mask"], "left_anti").select("image_id", "mask", F.col("mask").alias("root"))
    # each cluster's open mask: its root, the last mask that it has taken in, its pixels
    open_ = left.groupBy(*key).agg(F.min("mask").alias("root")).withColumn("last", F.col("root")).checkpoint()
    held = own.join(open_.select(*key, F.col("root").alias("mask")), [*key, "mask"]).select(*key, "x", "y").checkpoint()
    taken = [done, open_.select("image_id", F.col("root").alias("mask"), "root")]
    left = left.join(open_.select(*key, F.col("root").alias("mask")), [*key, "mask"], "left_anti").checkpoint()
    while not left.isEmpty():
        size = held.groupBy(*key).agg(F.count("*").alias("size"))
        met = held.join(own, [*key, "x", "y"]).groupBy(*key, "mask").agg(F.count("*").alias("shared"))
        met = met.join(left, [*key, "mask"]).join(open_, key).where("mask > last").join(size, key)
        hit = met.where(F.col("shared") / (F.col("size") + F.col("n") - F.col("shared")) > overlap).groupBy(*key).agg(F.min("mask").alias("mask"))
        # where nothing fits, the first mask that is left opens
        opens = left.groupBy(*key).agg(F.min("mask").alias("first")).join(hit, key, "left").join(open_, key)
        step = opens.select(*key, F.coalesce("mask", "first").alias("mask"), F.when(F.col("mask").isNotNull(), F.col("root")).otherwise(F.col("first")).alias("root"), F.col("mask").isNotNull().alias("grows")).checkpoint()
        added = own.join(step.select(*key, "mask"), [*key, "mask"]).select(*key, "x", "y")
        held = held.join(step.where("grows").select(*key), key, "left_semi").unionByName(added).distinct().checkpoint()
        taken.append(step.select("image_id", "mask", "root"))
        open_ = step.select(*key, "root", F.col("mask").alias("last"))
        left = left.join(step.select(*key, "mask"), [*key, "mask"], "left_anti").checkpoint()
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def presence(images: DataFrame, masks: DataFrame, roots: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Per image (image_id, size in pixels): presence in 0..1, uncertainty, groups.

    masks: image_id, mask (in order), score, area (sum of its soft values). Groups take the scores of the first masks, in order, as many
    as there are groups; those of at least `confidence` stay, and weigh the areas of the first masks, in order, as many as stay.
    Without any, presence is 0 and uncertainty 1.
    """
    own = W.partitionBy("image_id").orderBy("mask")
    ranked = masks.withColumn("at", F.row_number().over(own))
    groups = roots.groupBy("image_id").agg(F.count_distinct("root").alias("groups"))
    sure = ranked.join(groups, "image_id").where((F.col("at") <= F.col("groups")) & (F.col("score") >= confidence)).select("image_id", "score", F.row_number().over(own).alias("at"))
    sums = ranked.select("image_id", "at", "area").join(sure, ["image_id", "at"]).groupBy("image_id").agg(F.sum(F.col("area") * F.col("score")).alias("weight"), F.avg("score").alias("mean"))
    found = images.join(groups, "image_id", "left").join(sums, "image_id", "left")
    return found.select("image_id", F.coalesce(F.least(F.greatest(F.try_divide("weight", "size"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("presence"), F.coalesce(1 - F.col("mean"), F.lit(1.0)).alias("uncertainty"), F.coalesce("groups", F.lit(0)).alias("groups"))
