"""Queries of reflections: every image as a room of 8 x 8 with partitions along its bright pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reflection as M
from ..operators.regions import runs
from . import views as V
from .catalog import query

# materials that a room's four sides take turns with, from its label on
MATERIALS = ["dark_glass", "plaster_matte", "0.5", "polished_stone", "clear_glass", "unheard_of", "mirror"]
_VALUES = ["0.8", "0.03", "0.5", "0.35", "0.45", "0.05", "0.95"]
WALL = 150


def corners(spark, d):
    own = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("plan_id"), "label")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate([(0, 0), (8, 0), (8, 8), (0, 8)]))))
    names = F.array(*(F.lit(m) for m in MATERIALS))
    return own.select("plan_id", "label", at.alias("c")).select("plan_id", "c.*", F.get(names, ((F.col("label") + F.col("c.k")) % len(MATERIALS)).cast("int")).alias("material"))


def partitions(spark, d):
    bright = V.pixels(spark, d).where(F.col("grey") > WALL).select("image_id", "x", "y")
    return runs(bright, "image_id").select(F.col("image_id").alias("plan_id"), F.lit(None).cast("string").alias("surface"), (F.col("lo") + 0.125).alias("x1"), (F.col("y") + 0.25).alias("y1"), (F.col("hi") + 0.875).alias("x2"), (F.col("y") + 0.75).alias("y2"))


def eyes(spark, d):
    return V.pixels(spark, d).where(F.col("grey") <= WALL).select(F.col("image_id").alias("plan_id"), (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"))


def _setting(spark, d):
    c = corners(spark, d)
    surfaces = M.room_surfaces(c)
    occluders = surfaces.drop("reflectance").unionByName(partitions(spark, d))
    return surfaces, M.interior_points(c), occluders


_TURN = lambda p, a, b: f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"
_CROSS = lambda p, q, a, b: f"(({_TURN(a, b, p)} > 0) <> ({_TURN(a, b, q)} > 0) AND ({_TURN(p, q, a)} > 0) <> ({_TURN(p, q, b)} > 0))"
_ROOMS = f"""l AS (SELECT vec_id AS plan_id, label FROM embeddings),
surfaces AS (SELECT plan_id, 'wall_' || k AS surface, CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(ex AS DOUBLE) AS ex, CAST(ey AS DOUBLE) AS ey, CAST([{", ".join(_VALUES)}][1 + (label + k) % 7] AS DOUBLE) AS reflectance
    FROM l, (VALUES (0, 0, 0, 8, 0), (1, 8, 0, 8, 8), (2, 8, 8, 0, 8), (3, 0, 8, 0, 0)) c(k, ax, ay, ex, ey)),
w AS (SELECT image_id, x, y, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM pixels WHERE grey > {WALL}),
walls AS (SELECT image_id AS plan_id, CAST(NULL AS VARCHAR) AS surface, min(x) + 0.125 AS ax, y + 0.25 AS ay, max(x) + 0.875 AS ex, y + 0.75 AS ey FROM w GROUP BY image_id, y, s),
occluders AS MATERIALIZED (SELECT plan_id, surface, ax, ay, ex, ey FROM surfaces UNION ALL SELECT plan_id, surface, CAST(ax AS DOUBLE), CAST(ay AS DOUBLE), CAST(ex AS DOUBLE), CAST(ey AS DOUBLE) FROM walls),
eyes AS (SELECT image_id AS plan_id, x + CAST(0.5 AS DOUBLE) AS px, y + CAST(0.5 AS DOUBLE) AS py FROM pixels WHERE grey <= {WALL})"""
# the line from p to q, its ends drawn in ey a millionth of the way to its middle, crosses no occluder but s
_FREE = lambda p, q: f"NOT EXISTS (SELECT 1 FROM (SELECT o.ax, o.ay, o.ex, o.ey, {p}x + (({p}x + {q}x) / 2 - {p}x) * 1e-6 AS ux, {p}y + (({p}y + {q}y) / 2 - {p}y) * 1e-6 AS uy, {q}x + (({p}x + {q}x) / 2 - {q}x) * 1e-6 AS vx, {q}y + (({p}y + {q}y) / 2 - {q}y) * 1e-6 AS vy FROM occluders o WHERE o.plan_id = g.plan_id AND (o.surface IS NULL OR o.surface <> g.surface)) z WHERE {_CROSS('z.u', 'z.v', 'z.a', 'z.e')})"
_IMAGES = f"""f AS (SELECT *, ((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS t, CAST(4 AS DOUBLE) AS ix, CAST(4 AS DOUBLE) AS iy FROM eyes JOIN surfaces USING (plan_id) WHERE reflectance >= 0.06),
g AS (SELECT *, ax + t * (ex - ax) AS fx, ay + t * (ey - ay) AS fy, sqrt(pow(px - ax - t * (ex - ax), 2) + pow(py - ay - t * (ey - ay), 2)) AS distance FROM f WHERE t BETWEEN 0 AND 1),
s AS (SELECT plan_id, px, py, surface, 2 * distance AS image_distance, 1.7 / (2 * distance) AS subtended, reflectance * (1.7 / (2 * distance)) AS intensity FROM g WHERE distance >= 1e-6 AND {_TURN('i', 'a', 'e')} * {_TURN('p', 'a', 'e')} >= 0 AND {_FREE('p', 'f')})"""


@query("geo16_self_images", f"+{_ROOMS}, {_IMAGES} SELECT plan_id, px, py, surface, round(image_distance, 6) AS image_distance, round(subtended, 6) AS subtended, round(intensity, 6) AS intensity FROM s")
def _(spark, d):
    surfaces, interior, occluders = _setting(spark, d)
    found = M.self_images(eyes(spark, d), surfaces, interior, occluders, side=None)
    return found.select("plan_id", "px", "py", "surface", *(F.round(c, 6).alias(c) for c in ("image_distance", "subtended", "intensity")))


@query("geo16_self_exposure", f"+{_ROOMS}, {_IMAGES}, n AS (SELECT plan_id, px, py, sum(intensity) AS raw, count(*) AS n, min(image_distance) AS nearest FROM s GROUP BY 1, 2, 3) SELECT plan_id, px, py, round(coalesce(raw, 0), 6) AS self_exposure, round(1 - exp(-coalesce(raw, 0) / 0.6), 6) AS self_exposure_index, coalesce(n, 0) AS n_self_images, round(nearest, 6) AS nearest_image_distance FROM eyes LEFT JOIN n USING (plan_id, px, py)")
def _(spark, d):
    surfaces, interior, occluders = _setting(spark, d)
    e = eyes(spark, d)
    found = M.self_exposure(e, M.self_images(e, surfaces, interior, occluders, side=None))
    return found.select(*(F.round(c, 6).alias(c) if c.startswith("self") or c.startswith("nearest") else F.col(c) for c in found.columns))


@query("geo16_reflected", f"""+{_ROOMS}, observers AS (SELECT plan_id, px AS ox, py AS oy FROM eyes WHERE py = 7.5 AND px IN (0.5, 7.5)),
pairs AS MATERIALIZED (SELECT e.plan_id, px, py, ox, oy FROM eyes e JOIN observers USING (plan_id)),
m AS (SELECT *, ((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS t, CAST(4 AS DOUBLE) AS ix, CAST(4 AS DOUBLE) AS iy FROM pairs JOIN surfaces USING (plan_id) WHERE reflectance >= 0.05),
i AS (SELECT *, 2 * (ax + t * (ex - ax)) - px AS mx, 2 * (ay + t * (ey - ay)) - py AS my FROM m WHERE {_TURN('i', 'a', 'e')} * {_TURN('p', 'a', 'e')} >= 0 AND {_TURN('i', 'a', 'e')} * {_TURN('o', 'a', 'e')} >= 0),
h AS (SELECT *, (ox - mx) * (ay - ey) - (oy - my) * (ax - ex) AS den FROM i WHERE {_CROSS('o', 'm', 'a', 'e')}),
k AS (SELECT *, ((ox - ax) * (ay - ey) - (oy - ay) * (ax - ex)) / den AS s FROM h WHERE abs(den) >= 1e-12),
g AS (SELECT *, ox + s * (mx - ox) AS fx, oy + s * (my - oy) AS fy FROM k WHERE s BETWEEN 0 AND 1),
v AS (SELECT DISTINCT plan_id, px, py, ox, oy, true AS seen FROM g WHERE {_FREE('o', 'f')} AND {_FREE('f', 'p')})
SELECT plan_id, px, py, count(*) FILTER (coalesce(seen, false)) AS n_reflected, count(*) FILTER (coalesce(seen, false)) / count(*) AS reflected_fraction FROM pairs LEFT JOIN v USING (plan_id, px, py, ox, oy) GROUP BY 1, 2, 3""")
def _(spark, d):
    surfaces, interior, occluders = _setting(spark, d)
    e = eyes(spark, d)
    observers = e.where("py = 7.5 AND px IN (0.5, 7.5)").select("plan_id", F.col("px").alias("ox"), F.col("py").alias("oy"))
    return M.reflected_fraction(M.seen_by_reflection(e, observers, surfaces, interior, occluders, side=None))
