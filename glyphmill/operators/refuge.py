"""Prospect and refuge, sight and sound between the cells of plans, as joins and aggregations.

A plan is rows (plan_id, x, y, wall). What an origin sees is rows of it and a cell, by lines or by rays (`sight`). Paths are
rounds of relaxation, each a join of the open front with its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir
from .sight import free_cells, grids, line_is_free, looks

LEVEL, BACKGROUND = 62.0, 35.0


def entrances(plan: DataFrame) -> DataFrame:
    """Free cells on the edge of the plan."""
    own = W.partitionBy("plan_id")
    p = plan.withColumns({"__w": F.max("x").over(own), "__h": F.max("y").over(own)})
    return p.where(~F.col("wall") & ((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("__w")) | (F.col("y") == F.col("__h")))).select("plan_id", "x", "y")


def sight_lines(origins: DataFrame, plan: DataFrame, radius: float | None = None) -> DataFrame:
    """origins: plan_id, ox, oy. (plan_id, ox, oy, x, y, visible) for each free cell of the plan (within radius): whether the line to it is free."""
    pairs = origins.join(grids(plan), "plan_id").join(free_cells(plan), "plan_id")
    if radius is not None:
        pairs = pairs.where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= radius)
    return pairs.select("plan_id", "ox", "oy", "x", "y", line_is_free(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("visible"))


def masks(origins: DataFrame, plan: DataFrame) -> DataFrame:
    """origins: plan_id, ox, oy. (plan_id, ox, oy, x, y, visible) for each free cell of the plan: whether a ray from the origin passes it."""
    each = looks(origins, plan).select("plan_id", "ox", "oy", "w", F.posexplode(F.arrays_zip("free", "seen")).alias("at", "c")).where("c.free")
    return each.select("plan_id", "ox", "oy", (F.col("at") % F.col("w")).cast("int").alias("x"), F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), F.col("c.seen").alias("visible"))


def dead_ground(lines: DataFrame, radius: float) -> DataFrame:
    """Per origin the share of free cells within the radius that it doesn't see."""
    near = lines.where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= radius)
    return near.groupBy("plan_id", "ox", "oy").agg((F.count_if(~F.col("visible")) / F.count("*")).alias("dead_ground"))


def exposure(lines: DataFrame, public: DataFrame) -> DataFrame:
    """Per origin the share of public cells (plan_id, x, y) that see it, and the rest as privacy; 0 and 1 without public cells."""
    seen = lines.join(public.select("plan_id", "x", "y").distinct().withColumn("__p", F.lit(True)), ["plan_id", "x", "y"], "left")
    c = seen.groupBy("plan_id", "ox", "oy").agg(F.count_if(F.col("__p") & F.col("visible")).alias("v"), F.count("__p").alias("n"))
    e = F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.0)
    return c.select("plan_id", "ox", "oy", e.alias("exposure"), (1 - e).alias("privacy"))


def covisibility(lines: DataFrame, integration: DataFrame) -> DataFrame:
    """integration: plan_id, x, y, integration. Per origin the visible cells' share of a plan's whole integration."""
    j = lines.join(integration, ["plan_id", "x", "y"])
    return j.groupBy("plan_id", "ox", "oy").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("visible"), F.col("integration"))), F.sum("integration")), F.lit(0.0)).alias("covisibility"))


def least_exposed_paths(lines: DataFrame, starts: DataFrame, penalty: float = 6.0) -> DataFrame:
    """starts: plan_id, x, y. (plan_id, ox, oy, x, y, cost): the least cost of each free cell from the starts in four directions.

    A step costs 1, and penalty more into a cell that the origin sees. Each round relaxes the cells whose cost has just
    fallen, until none does; rounds are cut from their lineage.
    """
    checkpoint_dir(lines.sparkSession)
    cells = lines.select("plan_id", "ox", "oy", "x", "y", (1 + F.when(F.col("visible"), penalty).otherwise(0.0)).alias("step")).checkpoint()
    best = cells.join(starts.select("plan_id", "x", "y").distinct(), ["plan_id", "x", "y"], "left_semi").select("plan_id", "ox", "oy", "x", "y", F.col("step").alias("cost")).withColumn("fresh", F.lit(True)).checkpoint()
    keys = ["plan_id", "ox", "oy", "x", "y"]
    while not best.where("fresh").isEmpty():
        moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
        front = best.where("fresh").select("plan_id", "ox", "oy", "x", "y", "cost", moves.alias("m")).select("plan_id", "ox", "oy", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "cost")
        reach = front.join(cells, keys).select(*keys, (F.col("cost") + F.col("step")).alias("cost"))
        old = best.select(*keys, F.col("cost").alias("old"), F.lit(None).cast("double").alias("cost"))
        merged = old.unionByName(reach.withColumn("old", F.lit(None).cast("double"))).groupBy(*keys).agg(F.min("old").alias("old"), F.min("cost").alias("new"))
        fell = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        best = merged.select(*keys, F.when(fell, F.col("new")).otherwise(F.col("old")).alias("cost"), F.coalesce(fell, F.lit(False)).alias("fresh")).checkpoint()
    return best.drop("fresh")


def first_detection(lines: DataFrame, costs: DataFrame) -> DataFrame:
    """Per origin the distance at which the least exposed way to it is first unseen, walking outward from it; at the entrance, if all of it is seen.

    The way is walked by rounds: each goes on to the neighbour of least cost, of equals the smallest (x, y).
    """
    checkpoint_dir(lines.sparkSession)
    keys = ["plan_id", "ox", "oy"]
    cells = costs.join(lines.select(*keys, "x", "y", "visible"), [*keys, "x", "y"]).checkpoint()
    at = cells.where("x = ox AND y = oy").select(*keys, "x", "y", "cost", "visible")
    done = None
    while True:
        stop = at.where("not visible").select(*keys, "x", "y")
        done = stop if done is None else done.union(stop)
        open_ = at.where("visible")
        moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
        near = open_.select(*keys, F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("cost").alias("fc"), moves.alias("m")).select(*keys, "fx", "fy", "fc", (F.col("fx") + F.col("m.dx")).alias("x"), (F.col("fy") + F.col("m.dy")).alias("y"))
        on = near.join(cells, [*keys, "x", "y"]).where("cost < fc").groupBy(*keys, "fx", "fy").agg(F.min(F.struct("cost", "x", "y", "visible")).alias("n"))
        end = open_.join(on.select(*keys, F.col("fx").alias("x"), F.col("fy").alias("y")), [*keys, "x", "y"], "left_anti").select(*keys, "x", "y")
        done = done.union(end)
        at = on.select(*keys, "n.x", "n.y", "n.cost", "n.visible").checkpoint()
        if at.isEmpty():
            return done.select(*keys, F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("first_detection"))
        done = done.checkpoint()


def prospect_refuge(depth: Column, enclosure: Column, dead: Column, diagonal: Column) -> Column:
    """Long sight, a solid boundary and little unseen ground nearby, each in 0..1, multiplied."""
    return F.least(F.lit(1.0), depth / diagonal) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), enclosure)) * (1 - dead)


# --- sound


def reverberant_floor(source: float, absorption: float, offset: float = 18.0) -> Column:
    """Level of the diffuse field in dB: hard rooms have a high one."""
    a = F.lit(min(max(absorption, 0.02), 0.98))
    return source - offset + 10 * F.log10((1 - a) / a)


def eavesdropping(cells: DataFrame, source: float = LEVEL, background: float = BACKGROUND, absorption: float | None = None, intelligible: float | None = None) -> DataFrame:
    """cells: distance along free ways (null where there's none), visible. Level, speech index and whether one listens unseen.

    With absorption, the reverberant floor is added to the level and counts as noise against the index. With `intelligible`,
    one listens where the index is over it, else where the level is over the background.
    """
    direct = source - 20 * F.log10(F.greatest(F.col("distance"), F.lit(1.0)))
    power = lambda db: F.pow(F.lit(10.0), db / 10)
    floor = reverberant_floor(source, absorption) if absorption is not None else None
    level = 10 * F.log10(power(direct) + power(floor)) if floor is not None else direct
    noise = power(F.lit(background)) + (power(floor) if floor is not None else F.lit(0.0))
    index = F.when(F.col("distance").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (direct - 10 * F.log10(noise) + 15) / 30))).otherwise(0.0)
    hears = index > intelligible if intelligible is not None else F.coalesce(level > background, F.lit(False))
    return cells.withColumns({"level": level, "speech_index": index, "eavesdrop": hears & ~F.col("visible")})


def eavesdropping_shares(heard: DataFrame, keys: list[str], background: float = BACKGROUND) -> DataFrame:
    """Shares of the free cells that hear unseen, of the unseen ones that do, and of all that hear."""
    n, dead = F.count("*"), F.count_if(~F.col("visible"))
    return heard.groupBy(*keys).agg((F.count_if("eavesdrop") / n).alias("eavesdrop_area"), (F.count_if("eavesdrop") / F.greatest(dead, F.lit(1))).alias("of_dead_ground"), (F.count_if(F.col("level") > background) / n).alias("audible_area"))
