"""What mirrors show: one's own image, and others by way of a surface, with sight blocked by partitions.

Surfaces and occluders are segments of a plan (plan_id, surface, x1, y1, x2, y2). Whether a line of sight is blocked is a join of
segments that cross, tested exactly. Two ways lead there: by a grid that both are laid over, so a line is tested only against the
occluders along it; or, without a grid (side None), against all occluders of its plan. The latter shuffles no line, since a plan's
rows meet anyway, and is for plans of few occluders, as rooms are; the grid is for large ones.

A surface reflects on the side of the plan's interior point. Segments that only touch, or lie on one another, don't block, nor
does the surface that a line ends on. A surface without a name blocks everything that crosses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How mirror-like materials are, names for pairs of study conditions, what an unknown one has.
REFLECTANCE = {
    "mirror": 0.95, "dark_glass": 0.80, "glass_window": 0.45, "polished_metal": 0.60, "polished_marble": 0.35, "polished_stone": 0.28, "brushed_metal": 0.30, "glossy_paint": 0.18, "wood_polished": 0.15,
    "wet_floor": 0.25, "wood_matte": 0.04, "concrete": 0.05, "plaster_matte": 0.03, "brick": 0.02, "carpet": 0.0, "fabric": 0.0, "acoustic_panel": 0.0,
}
PRESETS = {"mirror_glass": "dark_glass", "clear_glass": "glass_window", "polished_stone": "polished_marble", "matte_plaster": "plaster_matte", "raw_concrete": "concrete"}
UNKNOWN = 0.05
# Height of a person; least reflectance of one's own image and of others'; scale of the index; how far a line's ends are drawn in.
PERSON, LEAST_OWN, LEAST_SEEN, SCALE, DRAWN = 1.7, 0.06, 0.05, 0.6, 1e-6


def reflectance(material: Column) -> Column:
    """Of a preset's or material's name, or of a number as text (held in 0..1); UNKNOWN for other names, null for null."""
    known = F.create_map(*(F.lit(v) for k in {**REFLECTANCE, **PRESETS} for v in (k, REFLECTANCE[PRESETS.get(k, k)])))
    number = F.least(F.greatest(material.try_cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.when(material.isNotNull(), F.coalesce(F.try_element_at(known, material), F.when(material.try_cast("double").isNotNull(), number), F.lit(UNKNOWN)))


def turn(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """On which side of the directed line a -> b the point lies: over 0 on its left."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def crosses(p: list[Column], q: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Segments p q and a b cross properly."""
    return ((turn(*a, *b, *p) > 0) != (turn(*a, *b, *q) > 0)) & ((turn(*p, *q, *a) > 0) != (turn(*p, *q, *b) > 0))


def cells(x1: Column, y1: Column, x2: Column, y2: Column, side: float) -> Column:
    """The grid cells (cx, cy) that a segment touches: for each column of cells the rows between its ends there."""
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    place = lambda v, slack: F.floor(v / side + slack).cast("int")
    # up a steep line small errors of x are large ones of y, so a line within one column takes all its rows
    steep = (x2 - x1) == 0

    def rows(cx: Column) -> Column:
        a, b = F.greatest(cx * side, left), F.least((cx + 1) * side, right)
        at = lambda x: F.when(steep, y1).otherwise(y1 + (x - x1) * F.try_divide(y2 - y1, x2 - x1))
        ends = [F.when(steep, v).otherwise(at(x)) for v, x in ((F.least(y1, y2), a), (F.greatest(y1, y2), b))]
        low, high = F.greatest(F.least(*ends), F.least(y1, y2)), F.least(F.greatest(*ends), F.greatest(y1, y2))
        return F.transform(F.sequence(place(low, -1e-6), place(high, 1e-6)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(place(left, -1e-6), place(right, 1e-6)), rows))


def unblocked(lines: DataFrame, occluders: DataFrame, key: list[str], side: float | None = 1.0) -> DataFrame:
    """The lines (plan_id, ax, ay, bx, by, skip and `key`) that cross no occluder of their plan but the surface `skip`.

    side: of the grid's cells; None for no grid.
    """
    drawn = lambda p, q: F.col(p) + ((F.col(p) + F.col(q)) / 2 - F.col(p)) * DRAWN
    names = ["__x1", "__y1", "__x2", "__y2"]
    walls = occluders.select(F.col("plan_id").alias("__plan"), F.col("surface").alias("__name"), *(F.col(n[2:]).alias(n) for n in names))
    # exploded even without a grid: an end is then worked out once a line, not wherever it's compared
    ends = F.struct(drawn("ax", "bx").alias("ax"), drawn("ay", "by").alias("ay"), drawn("bx", "ax").alias("bx"), drawn("by", "ay").alias("by"))
    lined = lines.withColumn("__line", F.explode(F.array(ends)))
    line, wall = [F.col(f"__line.{c}") for c in ("ax", "ay", "bx", "by")], [F.col(n) for n in names]
    blocks = F.coalesce(F.col("__name") != F.col("skip"), F.lit(True)) & crosses(line[:2], line[2:], wall[:2], wall[2:])
    if side is None:
        return lined.join(walls, (F.col("plan_id") == F.col("__plan")) & blocks, "left_anti").drop("__line")
    laid = lined.withColumn("__cell", F.explode(cells(*line, side)))
    walls = walls.withColumn("__at", F.explode(cells(*wall, side)))
    hit = laid.join(walls, (F.col("plan_id") == F.col("__plan")) & (F.col("__cell") == F.col("__at")) & blocks)
    return lines.join(hit.select(*key).distinct(), key, "left_anti")


def _facing(px: str, py: str) -> Column:
    """The point isn't on the other side of the surface than the interior point."""
    line = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return turn(F.col("ix"), F.col("iy"), *line) * turn(F.col(px), F.col(py), *line) >= 0


def self_images(eyes: DataFrame, surfaces: DataFrame, interior: DataFrame, occluders: DataFrame, person: float = PERSON, least: float = LEAST_OWN, side: float | None = 1.0) -> DataFrame:
    """Per eye (plan_id, px, py) and surface in which it sees itself: reflectance, foot (fx, fy), distance, image_distance, subtended, intensity.

    interior: plan_id, ix, iy. The foot of the perpendicular must lie on the surface, the eye in front of it, the way be free.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, dx * dx + dy * dy)
    seen = eyes.repartition("plan_id").distinct().join(surfaces.where(F.col("reflectance") >= least), "plan_id").join(interior, "plan_id").withColumn("t", F.coalesce(t, F.lit(0.0)))
    seen = seen.withColumn("fx", F.col("x1") + F.col("t") * dx).withColumn("fy", F.col("y1") + F.col("t") * dy).withColumn("distance", F.hypot(F.col("px") - F.col("fx"), F.col("py") - F.col("fy")))
    seen = seen.where(F.col("t").between(0, 1) & (F.col("distance") >= 1e-6) & _facing("px", "py"))
    lines = seen.select("plan_id", "px", "py", "surface", "reflectance", "fx", "fy", "distance", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("surface").alias("skip"))
    free = unblocked(lines, occluders, ["plan_id", "px", "py", "surface"], side)
    size = F.lit(person) / (2 * F.col("distance"))
    return free.select("plan_id", "px", "py", "surface", "reflectance", "fx", "fy", "distance", (2 * F.col("distance")).alias("image_distance"), size.alias("subtended"), (F.col("reflectance") * size).alias("intensity"))


def self_exposure(eyes: DataFrame, images: DataFrame) -> DataFrame:
    """Per eye: self_exposure (sum of intensities), its index in 0..1, n_self_images and the nearest image's distance (null without images)."""
    none = F.lit(None).cast("double")
    both = eyes.select("plan_id", "px", "py", none.alias("intensity"), none.alias("image_distance"), F.lit(True).alias("eye")).repartition("plan_id").unionByName(images.select("plan_id", "px", "py", "intensity", "image_distance", F.lit(False).alias("eye")))
    sums = both.groupBy("plan_id", "px", "py").agg(F.sum("intensity").alias("raw"), F.count("intensity").alias("n"), F.min("image_distance").alias("nearest_image_distance"), F.bool_or("eye").alias("eye")).where("eye")
    raw = F.coalesce("raw", F.lit(0.0))
    return sums.select("plan_id", "px", "py", raw.alias("self_exposure"), (1 - F.exp(-raw / SCALE)).alias("self_exposure_index"), F.col("n").alias("n_self_images"), "nearest_image_distance")


def seen_by_reflection(targets: DataFrame, observers: DataFrame, surfaces: DataFrame, interior: DataFrame, occluders: DataFrame, least: float = LEAST_SEEN, side: float | None = 1.0) -> DataFrame:
    """Per target (plan_id, px, py) and observer (plan_id, ox, oy) of its plan: reflected_visible, by way of any one surface.

    The observer's line to the target's mirror image must cross the surface, both stand in front of it, and both legs be free.
    """
    keys = ["plan_id", "px", "py", "ox", "oy"]
    pairs = targets.repartition("plan_id").distinct().join(observers.repartition("plan_id").distinct(), "plan_id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    j = pairs.join(surfaces.where(F.col("reflectance") >= least), "plan_id").join(interior, "plan_id").where(_facing("ox", "oy") & _facing("px", "py")).withColumn("t", t)
    whole = (dx * dx + dy * dy) > 0
    image = lambda p, q, d: F.when(whole, 2 * (F.col(q) + F.col("t") * d) - F.col(p)).otherwise(F.col(p))
    # exploded, so the image is worked out once and not wherever it's compared
    j = j.withColumn("m", F.explode(F.array(F.struct(image("px", "x1", dx).alias("mx"), image("py", "y1", dy).alias("my"))))).select("*", "m.*")
    at = lambda *names: [F.col(n) for n in names]
    j = j.where(crosses(at("ox", "oy"), at("mx", "my"), at("x1", "y1"), at("x2", "y2")))
    den = (F.col("ox") - F.col("mx")) * -dy + (F.col("oy") - F.col("my")) * dx
    s = ((F.col("ox") - F.col("x1")) * -dy + (F.col("oy") - F.col("y1")) * dx) / den
    j = j.where(F.abs(den) >= 1e-12).withColumn("s", s).where(F.col("s").between(0, 1))
    j = j.withColumn("fx", F.col("ox") + F.col("s") * (F.col("mx") - F.col("ox"))).withColumn("fy", F.col("oy") + F.col("s") * (F.col("my") - F.col("oy")))
    leg = lambda df, a, b, c, d: df.select(*keys, "surface", "fx", "fy", F.col("surface").alias("skip"), F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(d).alias("by"))
    # the second leg is looked at only where the first is free
    first = unblocked(leg(j, "ox", "oy", "fx", "fy"), occluders, [*keys, "surface"], side)
    second = unblocked(leg(first, "fx", "fy", "px", "py"), occluders, [*keys, "surface"], side)
    both = pairs.select(*keys, F.lit(False).alias("seen")).unionByName(second.select(*keys, F.lit(True).alias("seen")))
    return both.groupBy(*keys).agg(F.bool_or("seen").alias("reflected_visible"))


def reflected_fraction(seen: DataFrame) -> DataFrame:
    """Per target the number and share of observers that see it by reflection."""
    return seen.groupBy("plan_id", "px", "py").agg(F.count_if("reflected_visible").alias("n_reflected"), (F.count_if("reflected_visible") / F.count("*")).alias("reflected_fraction"))


def room_surfaces(corners: DataFrame) -> DataFrame:
    """(plan_id, surface, x1, y1, x2, y2, reflectance) of rooms (plan_id, k, x, y, material): an edge from each corner to the next, the last to the first, with the corner's material."""
    from pyspark.sql import Window as W

    own = W.partitionBy("plan_id").orderBy("k")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(own), F.first(c).over(whole))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return corners.select("plan_id", F.concat(F.lit("wall_"), F.row_number().over(own) - 1).alias("surface"), x.alias("x1"), y.alias("y1"), after(x).alias("x2"), after(y).alias("y2"), reflectance(F.col("material")).alias("reflectance"))


def interior_points(corners: DataFrame) -> DataFrame:
    """(plan_id, ix, iy): the mean of the corners."""
    return corners.groupBy("plan_id").agg(F.avg("x").alias("ix"), F.avg("y").alias("iy"))
