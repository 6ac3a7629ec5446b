"""Composites of attributes, and canonical tags derived from summaries by fixed rules.

Rules work on long rows (item, key, value) so that one pass over the attributes feeds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

HIGH, MEDIUM, ROOM, COVERAGE, CONFIDENCE, SEMANTIC, MATERIAL = 5.5, 3.5, 0.20, 0.01, 0.30, 0.5, 0.04
#: Prefixes whose attributes become tags.
SEMANTIC_PREFIXES = ["style.", "cognitive.", "biophilia."]
_COLUMNS = ["item", "tag_key", "label", "namespace", "confidence", "source_analyzer", "attribute_key"]


def _tag(df: DataFrame, key: Column, label: Column, ns: Column, confidence: Column, analyzer: str, attribute: Column | None) -> DataFrame:
    return df.select("item", key.alias("tag_key"), label.alias("label"), ns.alias("namespace"), F.bround(confidence, 3).alias("confidence"), F.lit(analyzer).alias("source_analyzer"), (attribute if attribute is not None else F.lit(None).cast("string")).alias("attribute_key"))


def affordance_tags(scores: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """scores: item, id, score (1 to 7). High from 5.5, medium from 3.5, lower none; an unknown id is its own label."""
    s = scores.withColumn("score", F.col("score").cast("double"))
    if labels is not None:
        s = s.join(F.broadcast(labels.select("id", F.col("label").alias("known"))), "id", "left")
    else:
        s = s.withColumn("known", F.lit(None).cast("string"))
    s = s.withColumn("level", F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium")).where("level is not null")
    return _tag(s, F.concat(F.lit("affordance."), F.lower("id"), F.lit("."), "level"), F.concat(F.coalesce("known", "id"), F.lit(" ("), "level", F.lit(")")), F.lit("affordance"), (F.col("score") - 1) / 6, "affordance_lgbm", F.concat(F.lit("affordance."), "id"))


def room_tags(rooms: DataFrame) -> DataFrame:
    """rooms: item, label, p (the best coarse room). From a share of 0.20, inclusive."""
    r = rooms.where((F.col("label") != "") & (F.col("p") >= ROOM))
    return _tag(r, F.concat(F.lit("room_type."), "label"), F.initcap(F.replace("label", F.lit("_"), F.lit(" "))), F.lit("room_type"), F.col("p"), "places365", F.lit("room.type_coarse"))


def object_tags(objects: DataFrame) -> DataFrame:
    """objects: item, class_name, coverage, confidence."""
    o = objects.where((F.col("coverage") >= COVERAGE) & (F.col("confidence") >= CONFIDENCE))
    return _tag(o, F.concat(F.lit("object."), F.lower(F.replace("class_name", F.lit(" "), F.lit("_")))), F.initcap("class_name"), F.lit("object"), F.col("confidence"), "segmentation", None)


def attribute_tags(attributes: DataFrame) -> DataFrame:
    """attributes: item, key, value. Only semantic prefixes, from 0.5."""
    wanted = F.lit(False)
    for p in SEMANTIC_PREFIXES:
        wanted = wanted | F.col("key").startswith(p)
    return _tag(attributes.where(wanted & (F.col("value") >= SEMANTIC)), F.col("key"), S.title_label(F.col("key")), S.namespace(F.col("key")), F.col("value"), "science_pipeline", F.col("key"))


def material_tags(materials: DataFrame, engine: str = "materials") -> DataFrame:
    """materials: item, material, coverage_2d, coverage_3d, confidence. The share is the 3-d one where it's known."""
    m = materials.withColumn("name", F.lower(F.trim("material"))).withColumn("share", F.coalesce("coverage_3d", "coverage_2d", F.lit(0.0))).where((F.col("name") != "") & (F.col("share") >= MATERIAL))
    label = F.concat(F.initcap(F.replace("name", F.lit("_"), F.lit(" "))), F.lit(" "), F.bround(F.col("share") * 100, 0).cast("int").cast("string"), F.lit("%"))
    return _tag(m, F.concat(F.lit("material."), "name"), label, F.lit("material"), F.coalesce("confidence", "share"), engine, F.concat(F.lit("material.vlm."), "name", F.lit("_coverage_3d")))


def all_tags(rules: list[DataFrame]) -> DataFrame:
    """The union of rules, the first rule winning for a key of an item."""
    out = None
    for order, r in enumerate(rules):
        r = r.withColumn("rule", F.lit(order))
        out = r if out is None else out.unionByName(r)
    first = W.partitionBy("item", "tag_key").orderBy("rule", "label")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def missing_tags(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: the new rows whose keys aren't there yet."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with the new ones in place of those of equal keys."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


# --- composites


def mean_of_present(*terms: Column) -> Column:
    """Mean of the terms that aren't null; 0.5 if all are."""
    there = F.filter(F.array(*terms), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)).otherwise(F.lit(0.5))


def fluency(edge_density: Column, entropy: Column, contrast: Column) -> Column:
    return mean_of_present(S.clamp01(1 - edge_density / 0.25), S.inverted_u(entropy / 8), S.clamp01(1 - contrast / 10))


def biophilia(plant: Column, earth: Column, blue: Column, fractal: Column, naturalness: Column) -> Column:
    """0.3 plant + 0.7 mean of the others that are there; naturalness where there's nothing; null without any."""
    rest = F.filter(F.array(earth, blue, fractal), lambda x: x.isNotNull())
    mean = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)
    return F.when(plant.isNotNull() & (F.size(rest) > 0), 0.3 * plant + 0.7 * mean).when(F.size(rest) > 0, mean).when(plant.isNotNull(), plant).otherwise(naturalness)


def weighted_composite(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("score"))


# --- segments, materials, rooms


def merge_materials(rows: DataFrame) -> DataFrame:
    """rows: item, material, coverage_2d, coverage_3d, confidence, depth. One row a material; shares over 1 in sum are scaled."""
    m = rows.withColumn("material", F.lower(F.trim("material"))).groupBy("item", "material").agg(
        F.sum("coverage_2d").alias("coverage_2d"), F.sum("coverage_3d").alias("coverage_3d"), F.max("confidence").alias("confidence"), F.try_divide(F.sum(F.col("depth") * F.col("coverage_3d")), F.sum("coverage_3d")).alias("depth")
    )
    own = W.partitionBy("item")
    for c in ("coverage_2d", "coverage_3d"):
        m = m.withColumn(c, F.least(F.col(c), F.lit(1.0)))
        m = m.withColumn("__sum", F.sum(c).over(own)).withColumn(c, F.when(F.col("__sum") > 1, F.col(c) / F.col("__sum")).otherwise(F.col(c))).drop("__sum")
    return m


def coarse_rooms(probabilities: DataFrame, mapping: DataFrame) -> DataFrame:
    """probabilities: item, label, p; mapping: label, coarse. Shares of the coarse rooms, which add up to 1."""
    c = probabilities.join(F.broadcast(mapping), "label").groupBy("item", "coarse").agg(F.sum("p").alias("p"))
    return c.withColumn("p", F.try_divide(F.col("p"), F.sum("p").over(W.partitionBy("item"))))


def top_classes(probabilities: DataFrame, n: int = 4, alternative: float = 0.15) -> DataFrame:
    """The best class, and the next up to n above a share, ranked."""
    r = probabilities.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("p"), "label")))
    return r.where((F.col("rank") == 1) | ((F.col("rank") <= n) & (F.col("p") > alternative)))


def presence_counts(segments: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per item a count for each label of a closed vocabulary, 0 where it has none."""
    return segments.groupBy("item").pivot("label", vocabulary).count().fillna(0)


def nearest_pairs(segments: DataFrame, a: str, b: str) -> DataFrame:
    """Per item, the least distance between a segment of label a and one of b (different ones, if a is b); -1 without a pair."""
    x, y = segments.where(F.col("label") == a).select("item", "seg", "x", "y"), segments.where(F.col("label") == b).select("item", F.col("seg").alias("seg2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    p = x.join(y, "item").where(F.col("seg") < F.col("seg2") if a == b else F.lit(True))
    least = p.groupBy("item").agg(F.min(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("d"))
    return segments.select("item").distinct().join(least, "item", "left").select("item", F.coalesce("d", F.lit(-1.0)).alias("distance"))


def region_contrasts(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """features: item, region, feature, value; pairs: a, b. The difference of each feature between the two regions, where both have it."""
    f = features.where(F.col("value").isNotNull() & ~F.isnan("value"))
    x = f.join(F.broadcast(pairs), f["region"] == pairs["a"]).select("item", "a", "b", "feature", F.col("value").alias("va"))
    return x.join(f.select("item", F.col("region").alias("b"), "feature", F.col("value").alias("vb")), ["item", "b", "feature"]).select("item", "a", "b", "feature", (F.col("va") - F.col("vb")).alias("contrast"))


def spatial_vote(rows: DataFrame) -> DataFrame:
    """rows: item, class, material (null if undecided), margin. The undecided take the material of their class's best margin."""
    best = F.max_by("material", F.when(F.col("material").isNotNull(), F.col("margin"))).over(W.partitionBy("item", "class"))
    return rows.withColumn("material", F.coalesce("material", best))


def fallback_tags(attributes: DataFrame, done: DataFrame) -> DataFrame:
    """attributes: image_id, attribute_key, value. Tags read from attributes of images whose run isn't complete: semantic ones and room functions, from 0.5."""
    key = F.col("attribute_key")
    wanted = key.startswith("style.") | key.startswith("cognitive.") | F.contains(key, F.lit("room_function"))
    open_ = attributes.where(wanted & (F.col("value") >= SEMANTIC)).join(done.select("image_id").distinct(), "image_id", "left_anti")
    return open_.select("image_id", "attribute_key", S.title_label(key).alias("label"), F.col("value").alias("confidence"))
