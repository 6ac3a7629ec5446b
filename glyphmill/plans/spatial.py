"""Queries of pixels (embeddings as 8 x 8 images) and plan geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import grids as D
from ..operators import pixels as P
from ..operators import refuge as R
from ..operators import sight as S
from . import views as V
from .catalog import query


def grids(spark, d):
    """Embeddings as 8 x 8 grey images: an array a row."""
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 128).cast("int")).alias("g"))


def coloured(spark, d):
    """A row a pixel of images whose green and blue are the next two greys."""
    g = grids(spark, d).select("image_id", F.transform("g", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), (v - 128) * 3 + 128))).alias("g"))
    at = lambda i: F.get("g", F.pmod(i, F.size("g")))
    return g.select("image_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.struct(at(i).alias("r"), at(i + 1).alias("g"), at(i + 2).alias("b")))).alias("p")).select("image_id", "p.*")


_COLOURS = """q AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: greatest(0, least(255, CAST((floor((CAST(v AS DOUBLE) + 1) * 128) - 128) * 3 + 128 AS INTEGER)))) AS g FROM embeddings), p AS (SELECT image_id, g, unnest(range(len(g))) AS i FROM q), c AS (SELECT image_id, g[i + 1] AS r, g[(i + 1) % len(g) + 1] AS g, g[(i + 2) % len(g) + 1] AS b FROM p),
t AS (SELECT *, greatest(r, g, b) AS top, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS d FROM c), hsv AS (SELECT image_id, r, g, b, CASE WHEN d = 0 THEN 0 WHEN top = r THEN CASE WHEN g < b THEN (g - b) / d + 6 ELSE (g - b) / d END WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS h, CASE WHEN top > 0 THEN d / top ELSE 0 END AS s, CAST(top AS DOUBLE) AS v FROM t)"""


def _r(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("pix03_entropy", "+c AS (SELECT image_id, grey, count(*) AS c FROM pixels GROUP BY 1, 2) SELECT image_id, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 8, 6) AS entropy FROM c GROUP BY 1")
def _(spark, d):
    return _r(P.entropy(V.pixels(spark, d), ["image_id"]))


@query("pix06_cooccurrence", "+q AS (SELECT image_id, x, y, grey * 64 // 256 AS q FROM pixels) SELECT a.image_id, round(avg((a.q - b.q) * (a.q - b.q)), 6) AS contrast, round(avg(1 / (1 + (a.q - b.q) * (a.q - b.q))), 6) AS homogeneity FROM q a JOIN q b ON b.image_id = a.image_id AND b.x = a.x + 1 AND b.y = a.y GROUP BY 1")
def _(spark, d):
    near = D.quantised(D.neighbours(F.col("g"), 8, 1, 0))
    return _r(grids(spark, d).select("image_id", near.alias("p")).select("image_id", D.contrast(F.col("p")).alias("contrast"), D.homogeneity(F.col("p")).alias("homogeneity")))


@query("pix07_box_dimension", "+b AS (SELECT DISTINCT image_id, k, x // k AS bx, y // k AS by FROM pixels, (VALUES (1), (2), (4)) s(k) WHERE grey > 140), n AS (SELECT image_id, k, count(*) AS n FROM b GROUP BY 1, 2) SELECT image_id, round(regr_slope(ln(n), -ln(k)), 6) AS dimension FROM n GROUP BY 1")
def _(spark, d):
    return _r(P.box_dimension(V.pixels(spark, d), "grey > 140"))


@query("pix08_symmetry", "SELECT a.image_id, round((corr(a.grey, b.grey) + 1) / 2, 5) AS symmetry, round(avg((a.grey - b.grey) * (a.grey - b.grey)), 5) AS mse FROM pixels a JOIN pixels b ON b.image_id = a.image_id AND b.y = a.y AND b.x = 7 - a.x WHERE a.x < 4 GROUP BY 1")
def _(spark, d):
    p = grids(spark, d).select("image_id", D.mirrored(F.col("g"), 8).alias("p"))
    return p.select("image_id", F.round((D.correlation(F.col("p")) + 1) / 2, 5).alias("symmetry"), F.round(D.contrast(F.col("p")), 5).alias("mse"))


@query("pix22_clutter", "+t AS (SELECT image_id, x // 2 AS tx, y // 2 AS ty, avg(CASE WHEN grey > 140 THEN 1.0 ELSE 0.0 END) AS d FROM pixels GROUP BY 1, 2, 3) SELECT image_id, round(stddev_pop(d), 6) AS clutter, round(avg(d), 6) AS density FROM t GROUP BY 1")
def _(spark, d):
    return _r(P.tile_density(V.pixels(spark, d), "grey > 140", 2))


@query("pix05_edge_density", "SELECT a.image_id, count(*) FILTER (greatest(coalesce(abs(r.grey - a.grey), 0), coalesce(abs(b.grey - a.grey), 0)) > 20) AS edges FROM pixels a LEFT JOIN pixels r ON r.image_id = a.image_id AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN pixels b ON b.image_id = a.image_id AND b.x = a.x AND b.y = a.y + 1 GROUP BY 1")
def _(spark, d):
    return grids(spark, d).select("image_id", D.edges(F.col("g"), 8, 20).alias("edges"))


@query("pix32_luminance", "SELECT label, round(avg(grey), 5) AS mean, round(stddev_pop(grey), 5) AS rms FROM pixels GROUP BY 1")
def _(spark, d):
    return P.luminance(V.pixels(spark, d), ["label"]).select("label", F.round("mean", 5).alias("mean"), F.round("rms", 5).alias("rms"))


@query("pix10_low_level_kernels")
def _(spark, d):
    g = V.pixels(spark, d).groupBy(F.col("image_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", "grey"))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda x: F.repeat(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), x["grey"]))), 2, "0"), F.lit(3))), "")
    images = g.select("id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.unhex(hexed).alias("data"))
    return P.extract(images)


def plans(spark, d):
    """Every image as an 8 x 8 plan whose walls are the bright pixels."""
    return V.pixels(spark, d).select(F.col("image_id").alias("plan_id"), "x", "y", (F.col("grey") > 145).alias("wall"))


@query("geo01_free_share", "SELECT image_id AS plan_id, round(avg(CASE WHEN grey > 145 THEN 0.0 ELSE 1.0 END), 6) AS free FROM pixels GROUP BY 1")
def _(spark, d):
    return plans(spark, d).groupBy("plan_id").agg(F.round(F.avg((~F.col("wall")).cast("double")), 6).alias("free"))


def _cells(spark, d):
    return S.free_cells(plans(spark, d)).selectExpr("plan_id", "x AS ox", "y AS oy")


@query("geo04_isovists")
def _(spark, d):
    return S.isovists(_cells(spark, d), plans(spark, d)).withColumnsRenamed({"ox": "x", "oy": "y"})


_GRAPH = """fc AS (SELECT image_id AS plan_id, x, y, y * 8 + x AS v FROM pixels WHERE grey <= 145), gp AS (SELECT a.plan_id, a.v AS a, b.v AS b, a.x AS ox, a.y AS oy, b.x - a.x AS dx, b.y - a.y AS dy, 2 * greatest(abs(b.x - a.x), abs(b.y - a.y)) + 1 AS n FROM fc a JOIN fc b ON a.plan_id = b.plan_id AND a.v < b.v),
gs AS (SELECT plan_id, a, b, CAST(floor(oy + dy * (CAST(i AS DOUBLE) / n)) * 8 + floor(ox + dx * (CAST(i AS DOUBLE) / n)) AS INTEGER) AS v FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM gp)), ge AS (SELECT g.plan_id, a, b FROM gs g LEFT JOIN fc USING (plan_id, v) GROUP BY ALL HAVING bool_and(fc.x IS NOT NULL)),
e AS (SELECT plan_id, a, b FROM ge UNION ALL SELECT plan_id, b, a FROM ge), r(plan_id, a, b, depth) AS (SELECT plan_id, v, v, 0 FROM fc UNION SELECT r.plan_id, r.a, e.b, r.depth + 1 FROM r JOIN e ON e.plan_id = r.plan_id AND e.a = r.b WHERE r.depth < 8),
md AS (SELECT plan_id, a AS v, avg(d) AS m FROM (SELECT plan_id, a, b, min(depth) AS d FROM r WHERE a <> b GROUP BY ALL) GROUP BY ALL), dg AS (SELECT plan_id, a AS v, count(*) AS k FROM e GROUP BY ALL), li AS (SELECT x.plan_id, x.a AS v, count(*) AS links FROM e x JOIN e y ON y.plan_id = x.plan_id AND y.a = x.a JOIN e z ON z.plan_id = x.plan_id AND z.a = x.b AND z.b = y.b GROUP BY ALL),
g AS (SELECT plan_id, x, y, CAST(coalesce(k, 0) AS INTEGER) AS connectivity, m AS mean_depth, CASE WHEN n > 2 AND m > 1 THEN greatest(0, 2 * (n * (log2((n + 2) / 3) - 1) + 1) / ((n - 1) * (n - 2)) / (2 * (m - 1) / (n - 2))) ELSE 0 END AS integration, CASE WHEN k > 1 THEN coalesce(links, 0) / (k * (k - 1)) ELSE 0 END AS clustering
FROM fc JOIN (SELECT plan_id, CAST(count(*) AS DOUBLE) AS n FROM fc GROUP BY 1) USING (plan_id) LEFT JOIN md USING (plan_id, v) LEFT JOIN dg USING (plan_id, v) LEFT JOIN li USING (plan_id, v))"""


@query("geo05_visibility_graph", f"+{_GRAPH} SELECT plan_id, x, y, connectivity, round(mean_depth, 6) AS mean_depth, round(integration, 6) AS integration, round(clustering, 6) AS clustering FROM g")
def _(spark, d):
    g = S.visibility_graph(plans(spark, d))
    return g.select("plan_id", "x", "y", "connectivity", *(F.round(c, 6).alias(c) for c in ("mean_depth", "integration", "clustering")))


@query("geo05_intelligibility", f"+{_GRAPH} SELECT plan_id, round(CASE WHEN stddev_pop(connectivity) > 1e-9 AND stddev_pop(integration) > 1e-9 THEN pow(covar_pop(connectivity, integration), 2) / (var_pop(connectivity) * var_pop(integration)) ELSE 0 END, 6) AS intelligibility FROM g GROUP BY 1")
def _(spark, d):
    return G.intelligibility(S.visibility_graph(plans(spark, d))).select("plan_id", F.round("intelligibility", 6).alias("intelligibility"))


@query("geo13_geodesic")
def _(spark, d):
    return G.distances(plans(spark, d))


@query("geo14_audibility", "SELECT event_id, round(62 - 20 * log10(greatest(value, 1)), 6) AS level, 62 - 20 * log10(greatest(value, 1)) > 35 AND event_id % 2 = 1 AS eavesdrop FROM events")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.col("value").alias("distance"), (F.col("event_id") % 2 == 0).alias("visible"))
    return R.eavesdropping(e).select("event_id", F.round("level", 6).alias("level"), "eavesdrop")


@query("geo16_mirrors", "+s AS (SELECT image_id AS plan_id, x AS x1, y AS y1, x + 2 AS x2, y + 1 AS y2 FROM pixels WHERE pos % 16 = 0), v AS (SELECT image_id AS plan_id, x AS px, y AS py FROM pixels WHERE pos % 8 = 3), j AS (SELECT *, ((px - x1) * 2 + (py - y1)) / 5 AS t FROM v JOIN s USING (plan_id)) SELECT plan_id, px, py, round(2 * (x1 + 2 * t) - px, 6) + 0.0 AS ix, round(2 * (y1 + t) - py, 6) + 0.0 AS iy, round(2 * sqrt(pow(x1 + 2 * t - px, 2) + pow(y1 + t - py, 2)), 6) AS image_distance, t BETWEEN 0 AND 1 AS self_visible FROM j")
def _(spark, d):
    p = V.pixels(spark, d)
    s = p.where("pos % 16 = 0").select(F.col("image_id").alias("plan_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 2).alias("x2"), (F.col("y") + 1).alias("y2"))
    out = G.mirror_exposure(s, p.where("pos % 8 = 3").select(F.col("image_id").alias("plan_id"), F.col("x").alias("px"), F.col("y").alias("py")))
    return out.select("plan_id", "px", "py", *((F.round(c, 6) + 0.0).alias(c) for c in ("ix", "iy", "image_distance")), "self_visible")


@query("pix04_spatial_entropy", """+q AS (SELECT image_id, x, y, grey // 8 AS q FROM pixels), a AS (SELECT a.image_id, k, a.q AS i, b.q AS j FROM q a, q b, (VALUES (0, 1, 0), (1, 1, -1), (2, 0, -1)) o(k, dx, dy) WHERE b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy), w AS (SELECT image_id, k, i * 32 + j AS v FROM a UNION ALL SELECT image_id, k, j * 32 + i FROM a),
c AS (SELECT image_id, k, v, count(*) AS n FROM w GROUP BY ALL), e AS (SELECT image_id, k, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c GROUP BY 1, 2) SELECT image_id, round(least(sum(e) / 10, 1), 6) AS entropy FROM e GROUP BY 1""")
def _(spark, d):
    return _r(D.spatial_entropy(grids(spark, d), "image_id", "g", 8))


_BINS = ", ".join(f"round(avg(CASE WHEN s >= 0.05 AND least(abs(h - {c!r}), 1 - abs(h - {c!r})) < {1 / 12!r} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for n, c in D.HUES)


@query("pix17_hue_shares", f"+{_COLOURS} SELECT image_id, {_BINS}, round(avg(CASE WHEN s < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS white FROM hsv GROUP BY 1")
def _(spark, d):
    h, s, _v = D.hsv(F.col("r"), F.col("g"), F.col("b"))
    return _r(coloured(spark, d).select("image_id", h.alias("h"), s.alias("s")).groupBy("image_id").agg(*D.hue_shares(F.col("h"), F.col("s"))))


@query("add23_legacy_colour", f"+{_COLOURS} SELECT image_id, round(avg(v) / 255, 6) AS value, round(avg(s), 6) AS saturation, round(count(*) FILTER (h * 180 <= 60) / (count(*) FILTER (h * 180 <= 60) + count(*) FILTER (h * 180 BETWEEN 90 AND 150) + 1e-6), 6) AS warmth FROM hsv GROUP BY 1")
def _(spark, d):
    h, s, v = D.hsv(F.col("r"), F.col("g"), F.col("b"))
    p = coloured(spark, d).select("image_id", (h * 180).alias("h"), s.alias("s"), v.alias("v"))
    warm, cool = F.count_if(F.col("h") <= 60), F.count_if(F.col("h").between(90, 150))
    return _r(p.groupBy("image_id").agg((F.avg("v") / 255).alias("value"), F.avg("s").alias("saturation"), (warm / (warm + cool + 1e-6)).alias("warmth")))


@query("pix27_materials", f"+{_COLOURS}, m AS (SELECT image_id, avg(CASE WHEN h * 180 BETWEEN 5 AND 30 AND s * 255 > 30 AND v > 50 THEN 1.0 ELSE 0.0 END) AS wood, avg(CASE WHEN s * 255 < 30 AND v > 150 THEN 1.0 ELSE 0.0 END) AS metal, avg(CASE WHEN s * 255 < 60 AND v > 60 AND v < 200 THEN 1.0 ELSE 0.0 END) AS stone_concrete, avg(CASE WHEN s * 255 < 30 AND v > 180 THEN 1.0 ELSE 0.0 END) AS plaster_gypsum FROM hsv GROUP BY 1), u AS (UNPIVOT m ON wood, metal, stone_concrete, plaster_gypsum INTO NAME material VALUE coverage) SELECT image_id, material, round(coverage, 6) AS coverage FROM u WHERE coverage >= 0.01")
def _(spark, d):
    h, s, v = D.hsv(F.col("r"), F.col("g"), F.col("b"))
    p = coloured(spark, d).select("image_id", h.alias("h"), s.alias("s"), v.alias("v"))
    masks = D.material_masks(F.col("h"), F.col("s"), F.col("v"), F.lit(0), F.lit(0))
    names = ["wood", "metal", "stone_concrete", "plaster_gypsum"]
    wide = p.groupBy("image_id").agg(*(F.avg(masks[n].cast("double")).alias(n) for n in names))
    return _r(wide.unpivot("image_id", names, "material", "coverage").where("coverage >= 0.01"))


@query("pix41_box_slopes", "+b AS (SELECT DISTINCT image_id, k, x // k AS bx, y // k AS by FROM pixels, (VALUES (1), (2), (4), (8)) s(k) WHERE grey > 120), n AS (SELECT image_id, k, count(*) AS n FROM b GROUP BY 1, 2), d AS (SELECT image_id, (ln(n) - ln(lead(n) OVER (PARTITION BY image_id ORDER BY k))) / ln(2) AS d FROM n) SELECT image_id, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM d WHERE d IS NOT NULL GROUP BY 1")
def _(spark, d):
    return _r(P.box_slopes(V.pixels(spark, d), "grey > 120", (1, 2, 4, 8)))
