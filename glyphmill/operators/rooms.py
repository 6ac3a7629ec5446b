"""Segments and pixels of rooms: aggregates, coverage, consistency with objects, depth, and the shaping of model answers.

Segments are rows (item, seg, label, is_thing, area, y); class maps are rows a pixel (item, x, y, class, ...). One aggregation by
item (and class) each; no item is gathered anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels that count as furniture.
FURNITURE = ["chair", "dining table", "couch", "bed", "furniture-other-merged", "shelf"]
#: Coarse room, objects that speak for it, factor with one of them, factor without any; from a share of 0.1.
CONSISTENCY = [
    ("bathroom", ["toilet", "sink"], 1.3, 0.7),
    ("kitchen", ["oven", "refrigerator", "microwave", "toaster"], 1.3, 0.8),
    ("office", ["laptop", "keyboard", "mouse", "monitor", "computer"], 1.2, 1.0),
    ("living", ["couch", "tv", "remote"], 1.2, 1.0),
    ("dining", ["dining table", "chair", "wine glass", "fork", "knife"], 1.2, 1.0),
    ("bedroom", ["bed"], 1.3, 0.8),
]
#: Words in a location, and the band of the image that stands for it (top, bottom, left, right), the first that fits.
BANDS = [
    (["floor", "rug", "carpet"], (0.62, 1.0, 0.0, 1.0)),
    (["ceiling", "light", "pendant", "fixture"], (0.0, 0.24, 0.0, 1.0)),
    (["wall", "backsplash"], (0.18, 0.78, 0.0, 1.0)),
    (["counter", "countertop", "island", "tabletop"], (0.45, 0.7, 0.15, 0.85)),
    (["cabinet", "millwork", "shelf", "bookcase"], (0.3, 0.85, 0.0, 1.0)),
    (["window", "glass", "glazing", "window_frame"], (0.08, 0.7, 0.1, 0.9)),
    (["door", "frame"], (0.15, 0.88, 0.05, 0.95)),
    (["sofa", "chair", "upholstery", "bed", "headboard"], (0.32, 0.88, 0.08, 0.92)),
]
#: Endings of room labels that say where, not what.
ENDINGS = ["_indoor", "_outdoor", "_interior", "_exterior"]


def room_aggregates(segments: DataFrame) -> DataFrame:
    """Per item counts of things and stuff, classes, areas, complexity and vertical spread."""
    thing, area = F.col("is_thing"), F.when(F.col("is_thing"), F.col("area"))
    s = segments.groupBy("item").agg(
        F.count_if(thing).alias("objects"), F.count_if(~thing).alias("stuff"), F.countDistinct("label").alias("classes"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(area), F.lit(0.0))).alias("free_floor"), F.coalesce(F.max(area), F.lit(0.0)).alias("largest"),
        F.coalesce(F.sum(F.when(F.col("label").isin(FURNITURE), area)), F.lit(0.0)).alias("furniture"), F.coalesce(F.avg(area), F.lit(0.0)).alias("mean_area"), F.coalesce(F.stddev_pop(area), F.lit(0.0)).alias("sd_area"), (F.max("y") - F.min("y")).alias("vertical_spread"),
    )
    return s.withColumn("complexity", F.col("objects") * F.col("classes"))


def consistent_rooms(rooms: DataFrame, objects: DataFrame) -> DataFrame:
    """rooms: item, coarse, p; objects: item, labels (array). Shares weighted by what objects say, adding up to 1; items without objects stay."""
    j = rooms.join(objects.select("item", F.transform("labels", lambda x: F.lower(x)).alias("__l")), "item", "left")
    factor = F.lit(1.0)
    for coarse, labels, there, absent in reversed(CONSISTENCY):
        factor = F.when(F.col("coarse") == coarse, F.when(F.arrays_overlap("__l", F.array(*map(F.lit, labels))), there).otherwise(absent)).otherwise(factor)
    j = j.withColumn("p", F.when((F.col("p") > 0.1) & (F.size(F.coalesce("__l", F.array())) > 0), F.col("p") * factor).otherwise(F.col("p")))
    return j.drop("__l").withColumn("p", F.try_divide(F.col("p"), F.sum("p").over(W.partitionBy("item"))))


def plain_room(label: Column) -> Column:
    """Lower case with underscores, without an ending that says where."""
    return F.regexp_replace(F.translate(F.lower(label), " -", "__"), f"({'|'.join(ENDINGS)})$", "")


def class_coverage(pixels: DataFrame, least: int = 100) -> DataFrame:
    """pixels: item, class. Share of the item's pixels of each class with at least `least` of them."""
    c = pixels.groupBy("item", "class").agg(F.count("*").alias("px"))
    return c.withColumn("coverage", F.col("px") / F.sum("px").over(W.partitionBy("item"))).where(F.col("px") >= least)


def instance_coverage(masks: DataFrame, sizes: DataFrame, least: int = 100) -> DataFrame:
    """masks: item, instance, class, x, y (a row a pixel; instances may overlap); sizes: item, total.

    (item, class, n, coverage) of instances with at least `least` pixels, and per item class null: their number and the share
    of pixels in any instance at all.
    """
    each = masks.groupBy("item", "instance", "class").agg(F.count("*").alias("px")).where(F.col("px") >= least)
    by = each.groupBy("item", "class").agg(F.count("*").alias("n"), F.sum("px").alias("px"))
    whole = masks.select("item", "x", "y").distinct().groupBy("item").agg(F.count("*").alias("px")).join(each.groupBy("item").agg(F.count("*").alias("n")), "item", "left").select("item", F.lit(None).cast(masks.schema["class"].dataType).alias("class"), F.coalesce("n", F.lit(0)).alias("n"), "px")
    return by.union(whole).join(sizes, "item").select("item", "class", "n", (F.col("px") / F.col("total")).alias("coverage"))


def region_coverage(pixels: DataFrame, vocabulary: DataFrame, shell: list[str] | None = None) -> DataFrame:
    """pixels: item, class; vocabulary: class, region. Share of the item's pixels in each region; shell: only these regions."""
    total = pixels.groupBy("item").agg(F.count("*").alias("total"))
    r = pixels.join(vocabulary, "class").groupBy("item", "region").agg(F.count("*").alias("px")).join(total, "item").select("item", "region", (F.col("px") / F.col("total")).alias("coverage"))
    return r.where(F.col("region").isin(shell)) if shell else r


def focal_contrast(walls: DataFrame) -> DataFrame:
    """walls: item, focal, value. The focal wall's value less the mean of the others, where both are there."""
    c = walls.groupBy("item").agg((F.max(F.when(F.col("focal"), F.col("value"))) - F.avg(F.when(~F.col("focal"), F.col("value")))).alias("contrast"))
    return c.where("contrast is not null")


def texture_presence(pixels: DataFrame, natural: list[str], fraction: float | None = None, confidence: float = 0.0) -> DataFrame:
    """pixels: item, superpixel, x, y, logits (map class -> logit). Per item and natural class its share of probability; class null: all of them.

    With `fraction`, a class counts only in superpixels of which at least that share has it as the likeliest class, with a mean
    probability of at least `confidence`.
    """
    top = F.array_max(F.map_values("logits"))
    e = F.transform_values("logits", lambda _, v: F.exp(v - top))
    z = F.aggregate(F.map_values(e), F.lit(0.0), lambda a, v: a + v)
    p = pixels.select("item", "superpixel", F.explode(F.transform_values(e, lambda _, v: v / z)).alias("class", "p"), F.element_at(F.array_sort(F.filter(F.map_entries("logits"), lambda x: x["value"] == top)), 1)["key"].alias("best"))
    sums = p.where(F.col("class").isin(natural)).groupBy("item", "superpixel", "class").agg(F.sum("p").alias("mass"), F.count("*").alias("n"), F.count_if(F.col("best") == F.col("class")).alias("own"))
    kept = sums if fraction is None else sums.withColumn("mass", F.when((F.col("own") / F.col("n") >= fraction) & (F.col("mass") / F.col("n") >= confidence), F.col("mass")).otherwise(0.0))
    by = kept.groupBy("item", "class").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"))
    each = by.select("item", "class", F.least(F.lit(1.0), F.col("mass") / F.col("n")).alias("presence"))
    return each.union(by.groupBy("item").agg(F.sum("mass").alias("mass"), F.max("n").alias("n")).select("item", F.lit(None).cast("string"), F.least(F.lit(1.0), F.col("mass") / F.col("n"))))


# --- depth


def oriented_depth(pixels: DataFrame) -> DataFrame:
    """pixels: item, x, y, depth. Depth as 0 near to 1 far: turned round where the lowest fifth has more of it than the highest; under 8 rows it stays."""
    d = F.when(F.isnan("depth") | F.col("depth").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("depth"))))
    p = pixels.withColumn("depth", d).withColumn("__h", F.max("y").over(W.partitionBy("item")) + 1)
    own = W.partitionBy("item")
    top = F.avg(F.when(F.col("y") < F.greatest(F.lit(1), F.floor(F.col("__h") / 5)), F.col("depth"))).over(own)
    bottom = F.avg(F.when(F.col("y") >= F.floor(F.col("__h") * 0.8), F.col("depth"))).over(own)
    return p.withColumn("depth", F.when((F.col("__h") >= 8) & (bottom > top), 1 - F.col("depth")).otherwise(F.col("depth"))).drop("__h")


def scaled_depth(pixels: DataFrame) -> DataFrame:
    """Depth stretched to 0..1 within an item; 0 where it's all the same."""
    own = W.partitionBy("item")
    lo, hi = F.min("depth").over(own), F.max("depth").over(own)
    return pixels.withColumn("depth", F.when(hi > lo, (F.col("depth") - lo) / (hi - lo)).otherwise(0.0))


def depth_summary(pixels: DataFrame) -> DataFrame:
    """Mean and half the deviation, both in 0..1."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return pixels.groupBy("item").agg(clip(F.avg("depth")).alias("mean_depth"), clip(F.stddev_pop("depth") / 2).alias("contrast"))


def weighted_coverage(pixels: DataFrame, mask: Column) -> DataFrame:
    """pixels: item, depth (0 near, 1 far). Share of the pixels where mask holds, and of their surface: farther ones stand for more of it."""
    w = 1 + 1.5 * F.pow("depth", F.lit(1.35))
    c = pixels.groupBy("item").agg((F.count_if(mask) / F.count("*")).alias("coverage_2d"), (F.coalesce(F.sum(F.when(mask, w)), F.lit(0.0)) / F.sum(w)).alias("coverage_3d"), F.coalesce(F.avg(F.when(mask, F.col("depth"))), F.lit(0.0)).alias("depth_mean"))
    return c.withColumn("depth_factor", F.when(F.col("coverage_2d") > 0, F.col("coverage_3d") / F.col("coverage_2d")).otherwise(1.0))


def location_band(location: Column) -> Column:
    """(top, bottom, left, right) shares of the image that a location's words stand for; all of it for others."""
    low, out = F.lower(location), F.struct(*(F.lit(v).alias(n) for n, v in zip(("y0", "y1", "x0", "x1"), (0.0, 1.0, 0.0, 1.0), strict=True)))
    for words, band in reversed(BANDS):
        fits = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
        out = F.when(fits, F.struct(*(F.lit(v).alias(n) for n, v in zip(("y0", "y1", "x0", "x1"), band, strict=True)))).otherwise(out)
    return out


def shallow_isovist(pixels: DataFrame, share: float = 0.6) -> DataFrame:
    """pixels: item, x, y, depth. Share of the pixels nearer than the percentile, their border (pixels with a neighbour outside) and compactness."""
    cut = pixels.groupBy("item").agg(F.percentile("depth", share).alias("t"))
    free = pixels.join(cut, "item").select("item", "x", "y", (F.col("depth") < F.col("t")).alias("free"))
    # each pixel tells its four neighbours that it's free: a sum, not a join
    said = free.where("free").select("item", F.explode(F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"), F.lit(k).alias("own")) for a, b, k in ((0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0))))).alias("s")).select("item", "s.*")
    near = said.groupBy("item", "x", "y").agg(F.max("own").alias("own"), (F.count("*") - F.max("own")).alias("n")).where("own = 1")
    border = near.groupBy("item").agg(F.count_if(F.col("n") < 4).alias("perimeter"))
    area = free.groupBy("item").agg(F.avg(F.col("free").cast("double")).alias("area"))
    j = area.join(border, "item", "left").select("item", "area", F.coalesce("perimeter", F.lit(0)).alias("perimeter"))
    return j.withColumn("compactness", 4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter") + 1e-9))


# --- answers of models


def material_answer(payload: Column) -> Column:
    """The materials of a model's JSON answer, largest coverage first; numbers are clamped to 0..1, other kinds of values have defaults."""
    kind = "array<struct<material:string,location:string,coverage:double,confidence:double,finish:string,color_tone:string>>"
    got = F.from_json(F.get_json_object(payload, "$.materials"), kind)
    clip = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.lit(0.0))
    text = lambda c, d: F.coalesce(c, F.lit(d))
    rows = F.transform(F.filter(got, lambda m: m.isNotNull()), lambda m: F.struct(text(m["material"], "unknown").alias("material"), text(m["location"], "unknown").alias("location"), clip(m["coverage"]).alias("coverage"), clip(m["confidence"]).alias("confidence"), text(m["finish"], "").alias("finish"), text(m["color_tone"], "").alias("color_tone")))
    order = lambda a, b: F.when(a["coverage"] > b["coverage"], -1).when(a["coverage"] < b["coverage"], 1).when(a["material"] < b["material"], -1).when(a["material"] > b["material"], 1).otherwise(0)
    return F.coalesce(F.array_sort(rows, order), F.array().cast(kind))


def indicator_features(payload: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """payload: item, affordance, name, polarity; vocabulary: affordance, name (plain). (item, feature, value): 1 where said, for each item and entry, else 0."""
    plain = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"), F.lit("_"))
    polarity = F.lower("polarity")
    said = F.struct("affordance", plain.alias("name"), polarity.alias("polarity"))
    told = polarity.isin("positive", "negative") & F.col("affordance").isNotNull() & F.col("name").isNotNull()
    # one row an item with all that it says; the vocabulary's entries are looked up there, so what is said is shuffled once
    items = payload.select("item", F.when(told, said).alias("s")).groupBy("item").agg(F.collect_set("s").alias("said"))
    sides = vocabulary.select("affordance", "name", F.explode(F.array(F.lit("positive"), F.lit("negative"))).alias("polarity"))
    hit = F.when(F.col("item").isNotNull() & F.array_contains("said", F.struct("affordance", "name", "polarity")), 1.0)
    grid = items.join(F.broadcast(sides)).select("item", "affordance", "name", "polarity", hit.alias("hit"))
    return grid.select("item", F.concat(F.lit("ind_"), "affordance", F.when(F.col("polarity") == "positive", "_pos_").otherwise("_neg_"), "name").alias("feature"), F.coalesce("hit", F.lit(0.0)).alias("value"))
