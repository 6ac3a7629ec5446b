"""Queries of edges, regions, walls and masks over images (embeddings as 8 x 8 arrays)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import fractal as A
from ..operators import masks as M
from ..operators import matching as H
from ..operators import regions as R
from ..operators import walls as L
from . import views as V
from .catalog import query
from .spatial import grids

WIDTH, WALL, AREA = 8, 110, 6

# a pixel's neighbour, held inside the 8 x 8 image, in SQL
_AT = lambda g, dx, dy: f"{g}[1 + 8 * least(greatest(y + {dy}, 0), 7) + least(greatest(x + {dx}, 0), 7)]"
_SOBEL = lambda g: (f"({_AT(g, 1, -1)} - {_AT(g, -1, -1)}) + 2 * ({_AT(g, 1, 0)} - {_AT(g, -1, 0)}) + ({_AT(g, 1, 1)} - {_AT(g, -1, 1)})", f"({_AT(g, -1, 1)} - {_AT(g, -1, -1)}) + 2 * ({_AT(g, 0, 1)} - {_AT(g, 0, -1)}) + ({_AT(g, 1, 1)} - {_AT(g, 1, -1)})")
_CANDIDATES = f"""q AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 128) AS INTEGER)) AS g FROM embeddings),
i AS (SELECT image_id, g, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y FROM (SELECT *, unnest(range(len(g))) AS k FROM q)),
s AS (SELECT image_id, x, y, {_SOBEL("g")[0]} AS dx, {_SOBEL("g")[1]} AS dy FROM i),
m AS MATERIALIZED (SELECT *, CAST(dx * dx + dy * dy AS BIGINT) AS m, CASE WHEN abs(dy) * 32768 < abs(dx) * 13573 THEN 'row' WHEN abs(dy) * 32768 > abs(dx) * 13573 + abs(dx) * 65536 THEN 'column' WHEN (dx < 0) <> (dy < 0) THEN 'up' ELSE 'down' END AS way FROM s),
w AS (SELECT m.*, CASE way WHEN 'row' THEN -1 WHEN 'column' THEN 0 WHEN 'up' THEN 1 ELSE -1 END AS ox, CASE way WHEN 'row' THEN 0 ELSE -1 END AS oy FROM m),
c AS MATERIALIZED (SELECT w.image_id, w.x, w.y, w.m > 22500 AS strong FROM w LEFT JOIN m a ON a.image_id = w.image_id AND a.x = w.x + ox AND a.y = w.y + oy LEFT JOIN m b ON b.image_id = w.image_id AND b.x = w.x - ox AND b.y = w.y - oy
    WHERE w.m > 2500 AND w.m > coalesce(a.m, 0) AND CASE WHEN w.way IN ('row', 'column') THEN w.m >= coalesce(b.m, 0) ELSE w.m > coalesce(b.m, 0) END),
e AS (SELECT image_id, x, y FROM c WHERE strong UNION SELECT c.image_id, c.x, c.y FROM e JOIN c ON c.image_id = e.image_id AND abs(c.x - e.x) <= 1 AND abs(c.y - e.y) <= 1)"""


@query("pix01_edge_candidates", f"+{_CANDIDATES} SELECT image_id, x, y, strong FROM c")
def _(spark, d):
    return E.candidates(grids(spark, d), "image_id", "g", WIDTH)


@query("pix01_edge_pixels", f"+{_CANDIDATES} SELECT * FROM e")
def _(spark, d):
    return E.edge_pixels(grids(spark, d), "image_id", "g", WIDTH)


@query("pix05_edge_share", f"+{_CANDIDATES}, n AS (SELECT image_id, count(*) AS edges FROM e GROUP BY 1) SELECT q.image_id, coalesce(edges, 0) AS edges, coalesce(edges, 0) / 64 AS density FROM q LEFT JOIN n USING (image_id)")
def _(spark, d):
    return E.edge_density(grids(spark, d), "image_id", "g", WIDTH)


_ANGLES = [math.pi * k / 12 for k in range(12)]
_TURNS = ", ".join(f"({k}, {math.cos(a)!r}, {math.sin(a)!r})" for k, a in enumerate(_ANGLES))


@query("mod09_line_votes", f"+{_CANDIDATES}, t(angle, c, s) AS (VALUES {_TURNS}) SELECT image_id, angle, CAST(round_even(x * t.c + y * t.s, 0) AS INTEGER) AS rho, count(*) AS votes FROM e, t GROUP BY 1, 2, 3")
def _(spark, d):
    return E.votes(E.edge_pixels(grids(spark, d), "image_id", "g", WIDTH), "image_id", _ANGLES)


def rooms(spark, d):
    """Images with a mask of walls, depth, colours, windows and doors, all as arrays; every tenth label has no depth."""
    flat = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 128).cast("int")).alias("grey"), F.transform("embedding", lambda v: (v.cast("double") / 5 + 1) / 2).alias("deep"))
    shifted = lambda by: F.transform("grey", lambda v, i: (F.get("grey", F.pmod(i + by, F.size("grey"))) + 128) / 2)
    return flat.select("image_id", F.transform("grey", lambda v: v > WALL).alias("wall"), F.when(F.col("label") != 9, F.col("deep")).alias("depth"), shifted(0).alias("r"), shifted(1).alias("g"), shifted(2).alias("b"), F.transform("grey", lambda v: v > 155).alias("window"), F.transform("grey", lambda v, i: (v > 150) & (i >= 56)).alias("door"))


_SURFACES = f"""q AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 128) AS INTEGER) > {WALL}) AS w, list_transform(embedding, lambda v: (CAST(v AS DOUBLE) / 5 + 1) / 2) AS g FROM embeddings WHERE label <> 9),
i AS (SELECT image_id, w, g, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y FROM (SELECT *, unnest(range(len(g))) AS k FROM q)),
s AS MATERIALIZED (SELECT image_id, x, y, w[1 + 8 * y + x] AS wall, sqrt(pow({_SOBEL("g")[0]}, 2) + pow({_SOBEL("g")[1]}, 2)) > 0.12 AS jump FROM i),
p AS MATERIALIZED (SELECT image_id, x, y, 8 * y + x AS pos FROM s WHERE wall AND NOT EXISTS (SELECT 1 FROM s n WHERE n.image_id = s.image_id AND n.wall AND n.jump AND abs(n.x - s.x) + abs(n.y - s.y) <= 2)),
r AS (SELECT image_id, x, y, pos, pos AS root FROM p UNION SELECT p.image_id, p.x, p.y, p.pos, r.root FROM r JOIN p ON p.image_id = r.image_id AND abs(p.x - r.x) + abs(p.y - r.y) = 1 AND r.root < p.pos),
f AS (SELECT image_id, x, y, min(root) AS root FROM r GROUP BY ALL), l AS (SELECT image_id, x, y, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS region FROM f)"""


@query("mod09_surfaces", f"+{_SURFACES} SELECT image_id, region, count(*) AS size, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM l GROUP BY 1, 2")
def _(spark, d):
    deep = rooms(spark, d).where("depth IS NOT NULL")
    found = R.region_sizes(R.regions(L.whole_surfaces(deep, "image_id", WIDTH, "wall", "depth"), "image_id"), "image_id")
    return found.select("image_id", "region", "size", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("mod09_touching", f"+{_SURFACES} SELECT DISTINCT a.image_id, a.region AS a, b.region AS b FROM l a JOIN l b ON a.image_id = b.image_id AND a.region < b.region AND abs(a.x - b.x) + abs(a.y - b.y) <= 3")
def _(spark, d):
    deep = rooms(spark, d).where("depth IS NOT NULL")
    return L.touching(R.unfolded(R.regions(L.whole_surfaces(deep, "image_id", WIDTH, "wall", "depth"), "image_id"), "image_id"), "image_id")


@query("mod09_walls")
def _(spark, d):
    columns = L.corner_columns(E.edge_pixels(grids(spark, d), "image_id", "g", WIDTH), "image_id", WIDTH, 8)
    found = L.walls(rooms(spark, d), "image_id", WIDTH, columns, area=AREA)
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


MASKS = 6


def soft_masks(spark, d):
    """Six masks of each image, each its values moved on by 11 pixels: image_id, mask, score, x, y, value."""
    own = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    each = own.select("image_id", "e", F.explode(F.sequence(F.lit(0), F.lit(MASKS - 1))).alias("mask"))
    scored = each.select("image_id", "mask", F.least(F.greatest(0.5 + 2 * F.get("e", F.col("mask")), F.lit(0.0)), F.lit(1.0)).alias("score"), F.transform("e", lambda v, i: F.least(F.greatest(2 * F.get("e", F.pmod(i + 11 * F.col("mask"), F.size("e"))), F.lit(0.0)), F.lit(1.0))).alias("m"))
    at = scored.select("image_id", "mask", "score", F.posexplode("m").alias("pos", "value"))
    return at.select("image_id", "mask", "score", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), "value")


def solid(masks):
    return M.widened(masks.where(F.col("value") > M.SOLID).select("image_id", "mask", "x", "y"), 8, 8)


# an 8 x 8 mask is one number of 64 bits
_MASKS = """o AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, unnest(range(6)) AS mask FROM embeddings),
v AS MATERIALIZED (SELECT image_id, mask, least(greatest(0.5 + 2 * e[mask + 1], 0), 1) AS score, pos, least(greatest(2 * e[(pos + 11 * mask) % 64 + 1], 0), 1) AS value FROM (SELECT *, unnest(range(64)) AS pos FROM o)),
h AS (SELECT DISTINCT image_id, mask, (pos // 8 + dy) * 8 + pos % 8 + dx AS pos FROM v, (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b WHERE value > 0.5 AND pos // 8 + dy BETWEEN 0 AND 7 AND pos % 8 + dx BETWEEN 0 AND 7),
b AS MATERIALIZED (SELECT image_id, mask, bit_or(CAST(1 AS UBIGINT) << CAST(pos AS INTEGER)) AS bits FROM h GROUP BY 1, 2)"""


@query("cmp06_overlaps", f"+{_MASKS} SELECT a.image_id, CAST(a.mask AS INTEGER) AS a, CAST(b.mask AS INTEGER) AS b, CAST(bit_count(a.bits & b.bits) AS BIGINT) AS shared, round(bit_count(a.bits & b.bits) / bit_count(a.bits | b.bits), 9) AS overlap FROM b a JOIN b ON a.image_id = b.image_id AND a.mask < b.mask AND (a.bits & b.bits) <> 0")
def _(spark, d):
    return M.overlaps(solid(soft_masks(spark, d))).withColumn("overlap", F.round("overlap", 9))


# pairs of masks are met in order, one a step; taken: masks that are no longer left; root: of each so far
_MERGED = f"""{_MASKS}, r AS (SELECT image_id, max(score) FILTER (mask = 0) AS _s, {", ".join(f"coalesce(any_value(bits) FILTER (mask = {k}), 0) AS m{k}" for k in range(6))} FROM b JOIN (SELECT DISTINCT image_id, mask, score FROM v) USING (image_id, mask) GROUP BY 1),
g AS (SELECT image_id, [m0, m1, m2, m3, m4, m5] AS m, -1 AS step, CAST(0 AS UBIGINT) AS cur, false AS on_, list_transform([m0, m1, m2, m3, m4, m5], lambda x: CASE WHEN x = 0 THEN -2 ELSE -1 END) AS root FROM r
    UNION ALL SELECT image_id, m, step + 1, CASE WHEN i = j THEN m[i + 1] WHEN takes THEN cur | m[j + 1] ELSE cur END, CASE WHEN i = j THEN root[i + 1] = -1 ELSE on_ END, CASE WHEN (i = j AND root[i + 1] = -1) OR takes THEN list_transform(root, lambda x, k: CASE WHEN k = j + 1 THEN i ELSE x END) ELSE root END
    FROM (SELECT *, (step + 1) // 6 AS i, (step + 1) % 6 AS j, on_ AND (step + 1) % 6 > (step + 1) // 6 AND root[(step + 1) % 6 + 1] = -1 AND bit_count(cur & m[(step + 1) % 6 + 1]) > 0.3 * bit_count(cur | m[(step + 1) % 6 + 1]) AS takes FROM g WHERE step < 35)),
roots AS (SELECT image_id, CAST(mask AS INTEGER) AS mask, CAST(root[mask + 1] AS INTEGER) AS root FROM (SELECT image_id, root, unnest(range(6)) AS mask FROM g WHERE step = 35) WHERE root[mask + 1] >= 0)"""


@query("cmp06_merged_masks", f"+{_MERGED} SELECT * FROM roots")
def _(spark, d):
    return M.merged(solid(soft_masks(spark, d)))


@query("cmp06_plant_presence", f"""+{_MERGED}, n AS (SELECT image_id, count(DISTINCT root) AS groups FROM roots GROUP BY 1),
k AS (SELECT image_id, mask, any_value(score) AS score, sum(value) AS area, row_number() OVER (PARTITION BY image_id ORDER BY mask) AS pos FROM v JOIN (SELECT DISTINCT image_id, mask FROM b) USING (image_id, mask) GROUP BY 1, 2),
s AS (SELECT image_id, score, row_number() OVER (PARTITION BY image_id ORDER BY mask) AS pos FROM k JOIN n USING (image_id) WHERE pos <= groups AND score >= 0.5),
w AS (SELECT image_id, sum(area * s.score) AS weight, avg(s.score) AS mean FROM k JOIN s USING (image_id, pos) GROUP BY 1)
SELECT e.vec_id AS image_id, round(coalesce(least(greatest(weight / 64, 0), 1), 0), 6) AS presence, round(coalesce(1 - mean, 1), 6) AS uncertainty, coalesce(groups, 0) AS groups FROM embeddings e LEFT JOIN n ON n.image_id = e.vec_id LEFT JOIN w ON w.image_id = e.vec_id""")
def _(spark, d):
    soft = soft_masks(spark, d)
    own = soft.groupBy("image_id", "mask").agg(F.first("score").alias("score"), F.sum("value").alias("area"), F.max("value").alias("most")).where(F.col("most") > M.SOLID)
    images = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.size("embedding").alias("size"))
    found = M.presence(images, own, M.merged(solid(soft)))
    return found.select("image_id", F.round("presence", 6).alias("presence"), F.round("uncertainty", 6).alias("uncertainty"), "groups")


def tiled(spark, d):
    """Images of 16 x 16, of four embeddings each: image_id, x, y, edge."""
    p = V.pixels(spark, d)
    return p.select(F.floor(F.col("image_id") / 4).alias("image_id"), (F.col("x") + 8 * (F.col("image_id") % 2)).cast("int").alias("x"), (F.col("y") + 8 * F.floor(F.col("image_id") / 2 % 2)).cast("int").alias("y"), (F.col("grey") > 148).cast("int").alias("edge"))


@query("mod10_dimension_map", """+t AS MATERIALIZED (SELECT image_id // 4 AS image_id, x + 8 * (image_id % 2) AS x, y + 8 * (image_id // 2 % 2) AS y, grey > 148 AS edge FROM pixels),
o AS (SELECT i.image_id, ox, oy FROM (SELECT image_id, max(x) AS w, max(y) AS h FROM t GROUP BY 1) i, (SELECT unnest([0, 2, 4, 6, 8]) AS ox) a, (SELECT unnest([0, 2, 4, 6, 8]) AS oy) b WHERE ox + 7 <= w AND oy + 7 <= h),
c AS (SELECT o.image_id, ox, oy, s, count(DISTINCT CASE WHEN edge THEN (x - ox) // s * 16 + (y - oy) // s END) AS boxes, count(*) FILTER (edge) AS edges FROM o JOIN t ON t.image_id = o.image_id AND x BETWEEN ox AND ox + 7 AND y BETWEEN oy AND oy + 7, (SELECT unnest([4, 8]) AS s) z GROUP BY 1, 2, 3, 4),
f AS (SELECT image_id, ox, oy, -regr_slope(ln(boxes + 1e-10), ln(s)) AS dimension, min(edges) AS edges FROM c GROUP BY 1, 2, 3)
SELECT image_id, CAST(ox AS INTEGER) AS x, CAST(oy AS INTEGER) AS y, round(dimension, 6) AS dimension FROM f WHERE edges >= 0.64 AND dimension > 0.5 AND dimension < 2.5""")
def _(spark, d):
    found = A.dimension_map(tiled(spark, d), "image_id", window=8, stride=2)
    return found.select("image_id", "x", "y", F.round("dimension", 6).alias("dimension"))


@query("pix44_matched_histograms", """+r AS (SELECT image_id, pos, grey, row_number() OVER (PARTITION BY image_id ORDER BY grey, md5(image_id || ':' || pos)) - 1 AS r, count(*) OVER (PARTITION BY image_id) AS m FROM pixels),
t AS (SELECT grey AS v, sum(count(*)) OVER (ORDER BY grey) AS upto, sum(count(*)) OVER () AS total FROM pixels GROUP BY 1), k AS (SELECT DISTINCT r, m FROM r),
z AS (SELECT k.r, k.m, min(v) AS v FROM k JOIN t ON 2 * k.m * upto >= (2 * k.r + 1) * total GROUP BY 1, 2) SELECT image_id, pos, grey AS value, z.v AS matched FROM r JOIN z USING (r, m)""")
def _(spark, d):
    p = V.pixels(spark, d).select("image_id", "pos", F.col("grey").alias("value"))
    return H.matched(p, "image_id", H.average_histogram(p, "image_id"), F.md5(F.concat_ws(":", "image_id", "pos")))


@query("pix45_sign_test", """+d AS (SELECT p_brand, p_partkey, CAST(p_size - length(p_name) AS BIGINT) AS d FROM part), s AS (SELECT p_brand, k, sum(CASE WHEN substr(md5('s:' || p_partkey || ':' || ((k - 1) // 32)), CAST((k - 1) % 32 + 1 AS INTEGER), 1) < '8' THEN d ELSE -d END) AS s FROM d, range(1, 257) t(k) GROUP BY 1, 2),
o AS (SELECT p_brand, sum(d) AS seen, count(*) AS n FROM d GROUP BY 1) SELECT p_brand, n, round(seen / n, 6) AS mean, count(*) FILTER (s > seen) / 256 AS p_one, count(*) FILTER (abs(s) > abs(seen)) / 256 AS p_two FROM s JOIN o USING (p_brand) GROUP BY p_brand, n, seen""")
def _(spark, d):
    found = H.sign_test(V.table(spark, d, "part"), ["p_brand"], F.col("p_size"), F.length("p_name"), F.col("p_partkey"), seed="s")
    return found.withColumn("mean", F.round("mean", 6))
